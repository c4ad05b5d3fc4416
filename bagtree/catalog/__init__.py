"""One query per operator over the given tables, with the same result as plain SQL where SQL can say it."""

from bagtree.catalog import growth, ingest, quality, searching, trees, vectors  # noqa: F401  (they register queries)
from bagtree.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
