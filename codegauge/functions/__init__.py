"""Column expressions: byte view, text and path helpers, labels."""
