"""lectern.functions"""
