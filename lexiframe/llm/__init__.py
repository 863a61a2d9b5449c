"""Operators of a training-data pipeline: extraction, filters, duplicates, packing, binary output."""
