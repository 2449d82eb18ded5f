"""Media-catalogue analytics on Spark DataFrames."""
