"""Operators of a training-data pipeline: packing, scoring, quality, near-duplicates, extraction, mixing, language, sharding."""
