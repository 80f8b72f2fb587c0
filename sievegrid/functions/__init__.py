"""sievegrid.functions"""
