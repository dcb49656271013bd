"""Feed collection and record linkage on Spark DataFrames."""
