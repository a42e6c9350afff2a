"""tidewire.functions"""
