"""Operators for large text corpora: cleaning, deduplication, mixing, tokenising and scanning."""
