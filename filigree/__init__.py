"""Graph embedding and corpus processing on Spark DataFrames."""
