"""missive.streaming"""
