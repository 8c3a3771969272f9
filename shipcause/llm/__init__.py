"""Operators for preparing training data: filtering, near-duplicates, mixing, encoding, archives, search."""
