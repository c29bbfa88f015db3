"""missive.sources"""
