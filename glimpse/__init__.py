"""Batch moment retrieval and corpus preparation on Spark DataFrames."""
