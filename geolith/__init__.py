"""Geographic feature analytics on Spark DataFrames."""
