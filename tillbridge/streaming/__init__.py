"""Streaming forms of the keyed folds; the batch operators are their oracle."""
