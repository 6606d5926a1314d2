"""Code-graph and device-inventory analytics on Spark DataFrames."""
