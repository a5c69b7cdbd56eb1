"""Operators for preparing training data: scoring, deduplication, formatting, mixing, archiving."""
