"""Training-data operators: packing, deduplication, scoring, filtering, redaction and archives.

Nothing else in the library imports this subpackage.
"""
