"""Clickstream and performance-regression analytics on Spark DataFrames."""
