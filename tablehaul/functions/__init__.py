"""Column expressions: literals, names, text."""
