"""Operators: each takes and returns DataFrames, or columns of them."""
