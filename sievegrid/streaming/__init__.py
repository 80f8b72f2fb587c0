"""sievegrid.streaming"""
