"""Document retrieval and analytics on Spark DataFrames."""
