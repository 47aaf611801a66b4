"""Operators for preparing training text: deduplication, filters, tokens, packing, quality."""
