"""Operators for training-data pipelines: deduplication, filters, formatting, mixing and packing."""
