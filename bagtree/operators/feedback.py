"""Relevance feedback: the bag of an abstract picture made from the pictures of the best captions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagtree.functions.hashing import row_hash
from bagtree.operators.rank import BUCKETS, first_by_hash
from bagtree.sources.scratch import stage

# Fixed value: how many of the best captions give their pictures.
NEAREST_CAPTIONS = 5


def feedback_bag(ranked: DataFrame, features: DataFrame, salt: str = "feedback", buckets: int = BUCKETS) -> DataFrame:
    """(query_id, pos, vec, doc_id): the expanded query of each ranked list.

    ``ranked`` is (query_id, rank, doc_id), rank from 1; ``features`` is (doc_id, pos, vec). The document at rank r
    gives n / log2(r + 1) of its n vectors; of all given vectors a query keeps as many as its documents have on
    average. Both draws take the lowest md5.
    """
    # Few rows; as a written table their size is known, and the join can broadcast them or not by it.
    ranked = stage(ranked.select("query_id", "rank", "doc_id"), "ranked")
    # A query has few documents: their features are read once and kept, the sizes and both draws start from that.
    given = stage(ranked.join(features, "doc_id"), "given")

    sizes = ranked.join(
        given.groupBy("query_id", "doc_id").agg(F.count("*").alias("n")), ["query_id", "doc_id"], "left"
    )
    bag_sizes = sizes.groupBy("query_id").agg(
        F.floor(F.sum(F.coalesce("n", F.lit(0))) / F.count("*")).alias("bag_size")
    )

    key = (F.col("query_id"), F.col("doc_id"), F.col("pos"))
    drawn = first_by_hash(
        given.withColumn("draw", row_hash(salt, *key)),
        ["query_id", "doc_id"],
        "draw",
        ["pos"],
        F.floor(F.col("group_n") / F.log2(F.col("rank") + 1)),
        buckets,
    )
    pooled = drawn.drop("draw").join(bag_sizes, "query_id").withColumn("draw", row_hash(f"{salt}:pool", *key))
    kept = first_by_hash(pooled, ["query_id"], "draw", ["doc_id", "pos"], F.col("bag_size"), buckets)
    return kept.select("query_id", "doc_id", "pos", "vec")
