"""Operators for preparing training text: deduplication, filtering, counting and packing."""
