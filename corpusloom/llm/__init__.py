"""Operators for building training corpora. Nothing outside imports this package."""
