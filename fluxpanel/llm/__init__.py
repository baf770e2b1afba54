"""Training-data operators: language ID, URL filters, deduplication, packing,
licence and secret scans, mixing, exact vector search and language-model scoring.

Nothing outside this subpackage imports it; it imports nothing from its siblings.
"""
