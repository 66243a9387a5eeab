"""Column expressions: random keys, text clean-up and vector arithmetic."""
