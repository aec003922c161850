"""Operators for preparing training text: deduplication, filtering, scans, extraction, mixing, tokens."""
