"""Training-data operators: deduplication, packing, extraction, scans and search.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""
