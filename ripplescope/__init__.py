"""Change-impact analytics over Spark DataFrames."""
