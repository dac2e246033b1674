"""Operators for preparing training text: quality, licences, sharding, formatting, deduplication, privacy,
toxicity, search, tokenising and packing. Nothing outside this package imports it."""
