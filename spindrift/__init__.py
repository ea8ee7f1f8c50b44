"""Search-and-answer analytics on Spark DataFrames."""
