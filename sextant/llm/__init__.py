"""Operators for training-data pipelines: language ID, near-duplicates, tokenizing, mixing, scoring, formatting."""
