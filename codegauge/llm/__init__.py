"""Operators for building training corpora: dedup, filters, models, tokenizing and packing."""
