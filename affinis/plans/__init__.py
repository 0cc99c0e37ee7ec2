"""Whole plans: fixtures, registered queries with their SQL, training and prediction."""
