"""Corpus operators for training-data pipelines: counting, dedup, filtering, mixing and packing."""
