"""Operators: from DataFrames to DataFrames, lazily unless they say otherwise."""
