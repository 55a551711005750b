"""Scalar functions on Columns and on Python values."""
