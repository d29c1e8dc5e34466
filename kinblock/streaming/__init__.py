"""kinblock.streaming"""
