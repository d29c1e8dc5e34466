"""kinblock.plans"""
