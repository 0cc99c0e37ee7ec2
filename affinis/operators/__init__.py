"""Relational operators of record linkage: DataFrames in, DataFrames out."""
