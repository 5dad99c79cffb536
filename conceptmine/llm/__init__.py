"""Operators of a training-data pipeline, built on Spark DataFrames."""
