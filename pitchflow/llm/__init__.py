"""Operators of a training-data pipeline: filters, scans, near-duplicates, mixing, packing.

Nothing else in the package imports this one.
"""
