"""Operators for large text corpora: dedup, quality, mixing, packing, scans.

Nothing outside this folder imports it.
"""
