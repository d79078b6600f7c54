"""Splicing and expression analytics on Spark DataFrames."""
