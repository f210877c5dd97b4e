"""Property-graph construction, analytics and retrieval in Spark DataFrames."""
