"""missive.functions"""
