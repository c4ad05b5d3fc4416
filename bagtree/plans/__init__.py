"""Whole jobs over stored tables: ingest, train, append, search, evaluate."""
