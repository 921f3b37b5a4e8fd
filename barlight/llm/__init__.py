"""Operators for training-data collections. Nothing outside this package imports it."""
