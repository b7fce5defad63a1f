"""Temporal label-transport analytics on Spark DataFrames."""
