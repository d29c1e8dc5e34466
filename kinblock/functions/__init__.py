"""kinblock.functions"""
