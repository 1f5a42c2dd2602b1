"""Training-data operators: scans, scores, token counts, deduplication and packing of documents.

Nothing else in the library imports this subpackage.
"""
