"""Operators for building training data: extraction, filtering, packing, scoring and archives."""
