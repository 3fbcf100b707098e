"""Scalar functions over columns; nothing here reads or moves data."""
