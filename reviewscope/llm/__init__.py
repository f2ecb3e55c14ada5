"""Operators of a training-data pipeline: scans, near-duplicates, scoring, mixing, packing, archives."""
