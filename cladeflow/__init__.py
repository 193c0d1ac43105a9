"""Likelihood-based placement analytics on Spark DataFrames."""
