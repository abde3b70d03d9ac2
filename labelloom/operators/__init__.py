"""Transformations from DataFrames to DataFrames; no actions unless stated."""
