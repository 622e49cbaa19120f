"""Operators of a training-data pipeline: mixing, filtering, deduplication, packing and counts."""
