"""Logical plans: from elements to features."""
