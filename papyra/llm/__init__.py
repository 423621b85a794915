"""Training-data operators: deduplication, tokenisation, filters, archives, media columns and language ID.

Nothing outside this package imports it.
"""
