"""Operators for large text corpora: filtering, deduplication, tokenising, packing, scoring and search.

Nothing else in the library imports this subpackage.
"""
