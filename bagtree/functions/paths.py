"""Term ids are paths: '0' is the root, '0.3.7' the child 7 of its child 3."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROOT = "0"


def child_term(parent: Column, cluster: Column) -> Column:
    return F.concat(parent, F.lit("."), cluster.cast("string"))


def depth_of(term: Column) -> Column:
    return F.length(term) - F.length(F.replace(term, F.lit("."), F.lit("")))


def parent_term(term: Column) -> Column:
    """Null for the root."""
    return F.when(F.contains(term, F.lit(".")), F.regexp_replace(term, r"\.[0-9]+$", ""))


def terms_on_path(term: str) -> Column:
    """All terms from the root down to the named column's term, itself included."""
    return F.expr(f"transform(sequence(1, size(split({term}, '[.]'))), i -> substring_index({term}, '.', i))")
