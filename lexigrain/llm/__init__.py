"""Operators that prepare training data: deduplication, filters, mixing, packing, output."""
