"""Operators for training data: deduplication, search, filtering, packing, sharding."""
