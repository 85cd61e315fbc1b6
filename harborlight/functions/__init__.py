"""Column expressions: text rules and normalisers."""
