"""sievegrid: a Spark-native engine for curating language-model training data.

Every operator is a function from DataFrames (and plain parameters) to a
DataFrame; Catalyst plans the work.
"""
