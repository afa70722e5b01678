"""Whole queries over the given tables."""
