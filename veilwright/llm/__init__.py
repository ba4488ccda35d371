"""Operators for large text corpora: filters, deduplication, tokenisation, packing."""
