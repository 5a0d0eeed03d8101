"""Point-cloud and trajectory analytics on Spark DataFrames."""
