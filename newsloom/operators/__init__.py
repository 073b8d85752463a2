"""Relational building blocks, each a function from DataFrames to a DataFrame."""
