"""Operators for preparing training text: dedup, archives, filters, sharding, tokens, classifiers."""
