"""Operators of a training-data pipeline: dedup, filtering, mixing, packing, search, token files."""
