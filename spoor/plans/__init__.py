"""spoor.plans"""
