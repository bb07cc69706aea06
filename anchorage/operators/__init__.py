"""Operators on sequence tables: DataFrames in, DataFrames out, no actions."""
