"""Batch record linkage on Spark: sources, text functions, operators, and the plans that join them."""
