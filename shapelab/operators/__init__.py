"""Operators over tables: aggregates, references, sketches, classes, privacy, leaks."""
