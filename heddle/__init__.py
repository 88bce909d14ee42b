"""Heddle: versioned-archive analytics on Spark DataFrames."""
