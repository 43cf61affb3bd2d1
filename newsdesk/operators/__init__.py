"""Operators on DataFrames of the news tables."""
