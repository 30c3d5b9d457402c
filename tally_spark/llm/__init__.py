"""Training-data operators: deduplication, cleaning, scoring and packing of documents.

Nothing else in the library imports this subpackage.
"""
