"""missive.operators"""
