"""Operators: every function here takes DataFrames and returns a DataFrame."""
