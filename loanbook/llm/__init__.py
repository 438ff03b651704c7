"""Operators that prepare training text: filters, deduplication, search, archives, mixing and packing."""
