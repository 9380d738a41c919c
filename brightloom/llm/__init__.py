"""Operators on corpora of training texts. Nothing else in the library imports this package."""
