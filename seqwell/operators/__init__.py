"""Positional and accessor operators on DataFrames of (pos, elem)."""
