"""Educational-text analytics on Spark DataFrames."""
