"""Operators for text corpora used as training data. Nothing else in the library imports this package."""
