"""Iterative methods as driver loops over cached DataFrames."""
