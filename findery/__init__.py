"""Document retrieval, its evaluation, and training-data operators on Spark DataFrames."""
