"""The inverted index: how often each document is in each tree node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagtree.functions.paths import terms_on_path
from bagtree.functions.weights import idf


def term_counts(assigned: DataFrame, key: str, tf: str = "tf") -> DataFrame:
    """(term_id, key, tf) from features at their leaves, counting every node on the path.

    One exchange by (term, key). Rows are counted before it, so neither a document with very many features nor
    the root, which has all of them, makes a large group.
    """
    return (
        assigned.select(key, F.explode(terms_on_path("term_id")).alias("term_id"))
        .groupBy("term_id", key)
        .agg(F.count("*").alias(tf))
    )


def postings_of(assignments: DataFrame) -> DataFrame:
    return term_counts(assignments, "doc_id")


def term_stats_of(postings: DataFrame) -> DataFrame:
    """(term_id, df, total_tf)."""
    return postings.groupBy("term_id").agg(F.count("*").alias("df"), F.sum("tf").alias("total_tf"))


def docs_count_of(docs: DataFrame) -> DataFrame:
    """All documents of the tree in one row, those with empty bags included."""
    return docs.agg(F.count("*").alias("docs_count"))


def term_idf(term_stats: DataFrame, docs_count: Column) -> DataFrame:
    return term_stats.withColumn("idf", idf(docs_count, F.col("df")))
