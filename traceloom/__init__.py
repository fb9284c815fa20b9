"""Evidence analytics over Spark DataFrames."""
