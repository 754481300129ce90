"""Column expressions: text, vectors, numbers."""
