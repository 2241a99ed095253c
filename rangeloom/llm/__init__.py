"""Operators for text corpora: joins, dedup, tokenization, scans, search and sharding."""
