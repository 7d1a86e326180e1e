"""Operators of a training-data pipeline: search, mixing, scoring, filters, packing, near-duplicates.

Nothing outside this subpackage imports it.
"""
