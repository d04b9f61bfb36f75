"""Operators for texts of training corpora. Nothing outside this package imports it."""
