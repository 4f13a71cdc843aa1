"""Operators for building training data: search, filters, sharding, packing, mixing and deduplication."""
