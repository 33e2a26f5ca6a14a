"""Operators for training-data pipelines: dedup, tokenization, packing, scoring, filtering, sharding."""
