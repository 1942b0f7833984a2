"""Operators for large text corpora: formatting, counting, de-duplication, mixing, packing, indexing."""
