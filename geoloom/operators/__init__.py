"""Operators on DataFrames of features: de-duplication, ordering, covers."""
