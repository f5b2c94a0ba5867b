"""Archive and byte-stream analytics on Spark DataFrames."""
