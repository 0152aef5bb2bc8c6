"""Column expressions: text, arrays, hashing and metrics."""
