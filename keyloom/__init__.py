"""Keyed, ordered and indexed analytics over Spark DataFrames."""
