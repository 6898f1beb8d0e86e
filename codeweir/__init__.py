"""Hybrid search over code symbols and the checking of results, as Spark plans."""
