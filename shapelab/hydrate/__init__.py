"""Deterministic rows of a given shape, from column expressions over row numbers."""
