"""Review, price and resource-sample analytics on Spark DataFrames."""
