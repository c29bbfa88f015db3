"""missive.plans"""
