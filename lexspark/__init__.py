"""Retrieval analytics on Spark: parse, chunk, index, search, evaluate."""
__version__ = "0.2.0"
