"""Column functions: vectors, text, JSON."""
