"""Operators that prepare text for training models. Nothing outside this package imports it."""
