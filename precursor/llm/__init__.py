"""Operators for large text corpora: sharding, deduplication, language, privacy, packing, archives, secrets."""
