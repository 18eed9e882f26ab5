"""lectern.operators"""
