"""stillhouse: evidence and measurement analytics on Spark DataFrames."""
