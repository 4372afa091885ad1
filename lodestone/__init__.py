"""Document-retrieval analytics on Spark DataFrames.

Every operator takes DataFrames and returns DataFrames. See README.md for the
map from operator to module.
"""
