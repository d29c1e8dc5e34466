"""kinblock.operators"""
