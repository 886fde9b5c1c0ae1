"""Operators for text that is prepared as training data. Nothing outside this package imports it."""
