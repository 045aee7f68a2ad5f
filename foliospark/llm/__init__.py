"""Training-data operators: deduplication, decontamination, tokens, quality, packing.

Nothing else in the library imports this subpackage.
"""
