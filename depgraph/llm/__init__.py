"""Operators for building training corpora: sharding, filtering, deduplication, mixing and search."""
