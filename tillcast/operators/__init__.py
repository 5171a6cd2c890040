"""Operators: DataFrames in, a DataFrame out, nothing collected but plan-time scalars."""
