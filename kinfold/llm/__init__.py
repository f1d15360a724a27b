"""Operators for text corpora: deduplication, filtering, cleaning and tokenisation."""
