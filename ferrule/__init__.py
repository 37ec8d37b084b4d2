"""Sparse symmetric linear algebra on Spark DataFrames."""
