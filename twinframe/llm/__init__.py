"""Operators of a training-data pipeline: packing, filtering, de-duplication, archives, tokens."""
