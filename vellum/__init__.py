"""Document-set analytics on Spark: documents with their own data, queried, joined, rendered and sent as DataFrames."""
