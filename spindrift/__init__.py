"""Entity resolution, fusion, ranking and link analytics on Spark DataFrames."""
