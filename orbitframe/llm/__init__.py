"""Operators for text and vector corpora: tokenising, filtering, near duplicates, search, packing."""
