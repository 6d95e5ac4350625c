"""Operators for training-data pipelines over text: duplicates, splits, tokens, mixtures, shared spans."""
