"""Operators that prepare training text: dedup, filters, scans, packing and sharding."""
