"""Station-based exposure analytics on Spark DataFrames."""
