"""Training-data operators: deduplication, filtering, packing, formatting and search on Spark DataFrames."""
