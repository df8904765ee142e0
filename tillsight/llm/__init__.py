"""Operators of a training-data pipeline: search, filters, dedup, tokenizing,
packing, extraction and quality rules over document tables.

Nothing else in the library imports this subpackage."""
