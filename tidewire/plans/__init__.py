"""tidewire.plans"""
