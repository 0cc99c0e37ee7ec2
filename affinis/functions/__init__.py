"""Scalar functions of record linkage."""
