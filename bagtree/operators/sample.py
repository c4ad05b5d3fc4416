"""Drawing documents that a tree has not seen yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagtree.functions.hashing import hash_fraction, row_hash
from bagtree.functions.weights import sample_ratio


# Up to this many documents of a batch are named in the filter of the sample log.
NAMED_DOCS = 1000


def unsampled(docs: DataFrame, log: DataFrame, tree_id: str, namespace: str) -> DataFrame:
    """Documents that the sample log does not list for the tree."""
    seen = log.filter((F.col("tree_id") == tree_id) & (F.col("namespace") == namespace)).select("doc_id")
    return docs.join(seen, "doc_id", "left_anti")


def unsampled_of_batch(docs: DataFrame, log: DataFrame, tree_id: str, namespace: str) -> DataFrame:
    """The same for a batch that is small beside the log: the log is cut down to the batch's documents first, for which the
    batch, not the log, is broadcast or shuffled to it. Up to NAMED_DOCS documents are named to the log's scan, which lies in order of
    documents: it skips the row groups that hold none of them."""
    named = [row["doc_id"] for row in docs.select("doc_id").distinct().limit(NAMED_DOCS + 1).collect()]
    if len(named) <= NAMED_DOCS:
        own = log.filter(F.col("doc_id").isin(named))
    else:
        own = log.join(docs.select("doc_id"), "doc_id", "left_semi")
    return unsampled(docs, own, tree_id, namespace)


def unsampled_count(docs: DataFrame, log: DataFrame, tree_id: str, namespace: str) -> DataFrame:
    return unsampled(docs, log, tree_id, namespace).agg(F.count("*").alias("remaining"))


def sample_next(
    docs: DataFrame, log: DataFrame, size: int, tree_id: str, namespace: str, salt: str = "sample", repeatable: bool = True
) -> DataFrame:
    """About ``size`` unsampled documents by independent draws; a negative size asks for about one percent.

    A draw compares the md5 of (salt, tree, document) with the ratio, so a repeated run draws the same documents.
    ``repeatable=False`` draws with random numbers instead.
    """
    rest = unsampled(docs, log, tree_id, namespace)
    # The count is one value, read as a scalar subquery of the same plan.
    ratio = sample_ratio(size, unsampled_count(docs.select("doc_id"), log, tree_id, namespace).scalar())
    draw = hash_fraction(row_hash(f"{salt}:{tree_id}", F.col("doc_id"))) if repeatable else F.rand()
    return rest.filter(draw < ratio)


def by_doc(entries: DataFrame) -> DataFrame:
    """Log entries in order of documents, so that a reader skips row groups."""
    return entries.repartitionByRange("doc_id").sortWithinPartitions("doc_id")


def log_entries(sampled: DataFrame, tree_id: str, namespace: str) -> DataFrame:
    return sampled.select(
        "doc_id",
        F.lit(tree_id).alias("tree_id"),
        F.lit(namespace).alias("namespace"),
        F.current_timestamp().alias("sampled_at"),
    )
