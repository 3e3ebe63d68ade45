"""Operators for the preparation of language-model training data. Nothing else in the library imports them."""
