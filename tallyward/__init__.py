"""Batch and incremental analytics over geo-located incident records on Spark DataFrames."""

__version__ = "0.1.0"
