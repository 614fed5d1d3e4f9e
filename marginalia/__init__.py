"""Literature retrieval, citation and evaluation analytics on Spark DataFrames."""
