"""Operators for preparing text corpora: dedup, packing, tokenising, scoring, media columns.

Nothing outside this subpackage imports it.
"""
