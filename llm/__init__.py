"""Operators for large-scale training-data preparation, on Spark."""
