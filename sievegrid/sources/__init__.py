"""sievegrid.sources"""
