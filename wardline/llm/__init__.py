"""Operators for large training-data pipelines, their queries and their SQL."""
