"""spoor.operators"""
