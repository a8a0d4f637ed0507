"""Training-data operators: scoring, deduplication, filtering, packing and archives of large text tables.

Nothing else in the package imports this subpackage; it may be removed whole.
"""
