"""Build-log and source-code analytics on Spark DataFrames."""
