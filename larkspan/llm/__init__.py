"""Operators of a training-data pipeline: filters, dedup, mixing, tokens, output."""
