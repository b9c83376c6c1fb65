"""Relational and analytic operators: pure functions from DataFrames to DataFrames."""
