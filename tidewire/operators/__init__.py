"""tidewire.operators"""
