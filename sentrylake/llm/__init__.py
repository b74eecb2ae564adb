"""Operators of a training-data pipeline: counting, archives, mixing, scoring, cleaning, near duplicates, token output."""
