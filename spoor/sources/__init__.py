"""spoor.sources"""
