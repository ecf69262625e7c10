"""Operators that large training-data pipelines need; nothing else in the library imports them."""
