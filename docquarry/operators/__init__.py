"""Operators from DataFrames to DataFrames. Keys are named by their callers; ties are always broken by a column."""
