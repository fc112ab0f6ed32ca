"""spoor.functions"""
