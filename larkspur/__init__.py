"""A typed relational query engine on Spark DataFrames."""
