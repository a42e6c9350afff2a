"""Operators for preparing language-model training data.

Nothing else in tidewire imports this subpackage.
"""
