"""sievegrid.plans"""
