"""Operators for preparing text corpora: deduplication, screening, language, packing."""
