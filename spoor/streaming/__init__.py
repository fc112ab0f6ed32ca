"""spoor.streaming"""
