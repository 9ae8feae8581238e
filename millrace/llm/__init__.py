"""Operators for preparing training data: deduplication, filtering, language, tokens, packing."""
