"""Column expressions: rounding, unsigned arithmetic, value templates, text classes."""
