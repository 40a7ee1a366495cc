"""Queries and SQL of the training-data operators."""

from importlib import import_module

MODULES = ("urltree", "tiff", "tokenids", "pieces", "suffixtree", "mixing", "suffixes", "langid", "simhash", "vectors", "repair", "toxic", "prefixtrie")
_ALL = [import_module(f"{__package__}.{m}") for m in MODULES]
QUERIES = {k: f for m in _ALL for k, f in m.QUERIES.items()}
SQL = {k: q for m in _ALL for k, q in m.SQL.items()}
