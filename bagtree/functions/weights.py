"""Term weights, rank discounts and the sample size rule as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def idf(docs_count: Column, df: Column) -> Column:
    return F.log((F.lit(1) + docs_count) / (F.lit(1) + df))


def normalised_tf(tf: Column, query_tf: Column, total_tf: Column) -> Column:
    """The query's tf joins the denominator, for the query and for every document alike."""
    return tf / (query_tf + total_tf)


def rank_discount(rank: Column) -> Column:
    """1 / log2(rank + 1), rank counted from 1."""
    return F.lit(1.0) / F.log2(rank + 1)


def relevance_ratio(similarity: Column, ideal: Column) -> Column:
    return F.when(ideal <= 0, F.lit(0.0)).otherwise(similarity / ideal)


def sample_ratio(size: int, remaining: Column) -> Column:
    """Share of the remaining documents to draw; null if none remain.

    A negative size asks for about one percent, a size above the rest for all of it.
    """
    if size == 0:
        raise ValueError("sample size must not be 0")
    left = remaining.cast("double")
    wanted = left / 100 + 1 if size < 0 else F.lit(float(size))
    return F.when(remaining > 0, F.least(wanted / left, F.lit(1.0)))
