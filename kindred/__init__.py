"""Duplicate auditing and corpus preparation on Spark DataFrames."""
