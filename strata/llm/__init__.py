"""Operators of a training-data pipeline, expressed on Spark DataFrames."""
