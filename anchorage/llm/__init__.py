"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it.  Every module states, for its
operator, what happens with nulls, empty or very long texts, ties, repeated
rows, empty tables and extra columns.
"""
