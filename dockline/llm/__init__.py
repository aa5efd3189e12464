"""Operators on document text. Nothing outside this package imports it."""
