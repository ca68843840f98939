"""A relational query engine that runs on Spark DataFrames."""
