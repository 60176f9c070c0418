"""Rank candidate texts within a context with Spark DataFrames and Spark ML."""
