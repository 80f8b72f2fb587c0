"""sievegrid.operators"""
