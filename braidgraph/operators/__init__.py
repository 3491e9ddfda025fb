"""Operators over graph DataFrames."""
