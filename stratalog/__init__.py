"""Observation-history analytics on Spark DataFrames."""
