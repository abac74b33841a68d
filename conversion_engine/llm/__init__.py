"""Operators of a training-data pipeline: near duplicates, quality, personal data, packing, mixing."""
