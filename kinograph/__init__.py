"""Recommendation analytics as Spark batch and streaming jobs.

Every operator is a plain function from DataFrames to a DataFrame; see README.md.
"""
