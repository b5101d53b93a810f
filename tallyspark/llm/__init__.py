"""Operators for preparing training text: scoring, cleaning, deduplication, sharding and token output at scale."""
