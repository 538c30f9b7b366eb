"""Operators for text and training-data problems. Nothing outside this subpackage imports it."""
