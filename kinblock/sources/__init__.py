"""kinblock.sources"""
