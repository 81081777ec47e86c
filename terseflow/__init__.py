"""Context reduction and corpus analytics on Spark DataFrames."""
