"""Code-graph and incident analytics on Spark DataFrames."""
