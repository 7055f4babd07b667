"""Catalog analytics over program functions, expressed as Spark plans."""

__version__ = "0.1.0"
