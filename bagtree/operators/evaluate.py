"""Exact search and retrieval quality."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bagtree.functions import kernels
from bagtree.functions.vectors import clamp_at_zero, cosine
from bagtree.functions.weights import rank_discount, relevance_ratio
from bagtree.operators.search import SCORE_DIGITS, top_n
from bagtree.sources.scratch import stage

# The list lengths at which quality is measured; ideal lists have the largest.
NS = (1, 5, 10, 20)
MAX_N = 20

# Bytes of query vectors that go along with one pass over the captions.
QUERY_BLOCK_BYTES = 4 << 20


def exact_topk(captions: DataFrame, queries: DataFrame, n: int = MAX_N, block_bytes: int = QUERY_BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, doc_id, similarity): per query the n documents with the best caption, by cosine.

    ``captions`` is (doc_id, vec), ``queries`` (query_id, vec). Queries are broadcast in blocks of bounded size, a
    pass over the captions each. A partition sends on its n best documents per query instead of all pairs.
    """
    spark = captions.sparkSession
    # The block number needs a count of the queries before it, not their vectors in one place.
    shape = queries.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim")).first()
    if not shape["n"]:
        raise ValueError("no queries")
    per_block = max(1, block_bytes // (shape["dim"] * 8))
    blocks = -(-shape["n"] // per_block)
    doc_type = captions.schema["doc_id"].dataType.simpleString()
    query_type = queries.schema["query_id"].dataType.simpleString()
    found = None
    for block in range(blocks):
        # Hash blocks: about equal, and each may exceed the average only a little.
        part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        table = part.select("query_id", "vec").toArrow()
        matrix = kernels.vector_matrix(table.column("vec"), shape["dim"]).astype(np.float64)
        norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
        ids = table.column("query_id").combine_chunks()
        shared = spark.sparkContext.broadcast((ids, matrix / np.where(norms == 0, 1.0, norms)))
        best = captions.select("doc_id", "vec").mapInArrow(
            kernels.best_similarities(shared, n, SCORE_DIGITS),
            f"query_id {query_type}, doc_id {doc_type}, similarity double",
        )
        if blocks > 1:  # one block of queries at a time is kept on the executors
            best = stage(best, "best")
            shared.destroy()
        found = best if found is None else found.unionAll(best)
    per_doc = found.groupBy("query_id", "doc_id").agg(F.max("similarity").alias("similarity"))
    return top_n(per_doc, n, F.col("similarity").desc()).select("query_id", "rank", "doc_id", "similarity")


def ideal_relevances(captions: DataFrame, queries: DataFrame, n: int = MAX_N, order: str = "desc") -> DataFrame:
    """(query_id, rank, relevance): the n best similarities per query, best first or ('asc') best last."""
    best = exact_topk(captions, queries, n).select("query_id", "rank", F.col("similarity").alias("relevance"))
    if order == "desc":
        return best
    count = F.count("*").over(Window.partitionBy("query_id"))
    return best.withColumn("rank", (count + 1 - F.col("rank")).cast("int"))


def similarities(results: DataFrame, captions: DataFrame, queries: DataFrame) -> DataFrame:
    """Adds ``similarity``: the best cosine between the query and the result's captions, not below 0.

    Results without captions are left out. The pairs are as many as the results' captions; the maximum is taken
    before the exchange, so a document with very many captions stays cheap.
    """
    results = stage(results, "results")
    pairs = results.select("query_id", "doc_id").distinct().join(captions.select("doc_id", F.col("vec").alias("c_vec")), "doc_id")
    best = (
        pairs.join(queries.select("query_id", F.col("vec").alias("q_vec")), "query_id")
        .groupBy("query_id", "doc_id")
        .agg(F.round(clamp_at_zero(F.max(cosine(F.col("q_vec"), F.col("c_vec")))), SCORE_DIGITS).alias("similarity"))
    )
    return results.join(best, ["query_id", "doc_id"])


def relevances(scored: DataFrame, ideal: DataFrame) -> DataFrame:
    """Adds ``relevance``, the similarity relative to the ideal list's at the same rank."""
    ideals = ideal.select("query_id", "rank", F.col("relevance").alias("ideal"))
    return scored.join(ideals, ["query_id", "rank"]).withColumn(
        "relevance", relevance_ratio(F.col("similarity"), F.col("ideal"))
    )


def list_quality(relevant: DataFrame, by: list[str]) -> DataFrame:
    """Precision, DCG and nDCG of each list: mean relevance, and the discounted sum against its best order.

    ``ndcg_ideal`` compares with the sum of the ideal list instead, whose relevances are all 1.
    """
    best_first = Window.partitionBy(*by).orderBy(F.col("relevance").desc(), "rank")
    return (
        relevant.withColumn("best_rank", F.row_number().over(best_first))
        .groupBy(*by)
        .agg(
            F.avg("relevance").alias("precision"),
            F.sum(F.col("relevance") * rank_discount(F.col("rank"))).alias("dcg"),
            F.sum(F.col("relevance") * rank_discount(F.col("best_rank"))).alias("idcg"),
            F.sum(rank_discount(F.col("best_rank"))).alias("full_dcg"),
        )
        .withColumn("ndcg", _ratio(F.col("dcg"), F.col("idcg")))
        .withColumn("ndcg_ideal", _ratio(F.col("dcg"), F.col("full_dcg")))
        .drop("full_dcg")
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def cut_to_each_n(relevant: DataFrame, ns: tuple[int, ...] = NS) -> DataFrame:
    """Each list once per n, cut to its first n rows."""
    n = F.explode(F.array(*[F.lit(x) for x in ns]))
    return relevant.withColumn("n", n).filter(F.col("rank") <= F.col("n"))


def mean_quality(relevant: DataFrame, queries: DataFrame) -> DataFrame:
    """(variant, n, mean_precision, mean_ndcg) over all queries, one without results counting 0.

    ``relevant`` is (variant, n, query_id, rank, relevance).
    """
    lists = list_quality(relevant, ["variant", "n", "query_id"])
    total = queries.select("query_id").distinct().agg(F.count("*").alias("queries")).scalar()
    return lists.groupBy("variant", "n").agg(
        (F.sum("precision") / total).alias("mean_precision"), (F.sum("ndcg") / total).alias("mean_ndcg")
    )


def evaluate(relevant: DataFrame, queries: DataFrame, ns: tuple[int, ...] = NS) -> DataFrame:
    """The quality of (variant, query_id, rank, relevance) lists of the largest n, cut to every n."""
    return mean_quality(cut_to_each_n(relevant, ns), queries)


def recall(results: DataFrame, exact: DataFrame, ns: tuple[int, ...] = NS) -> DataFrame:
    """(n, recall): share of the exact first n that the search also has among its first n."""
    wanted = cut_to_each_n(exact.select("query_id", "rank", "doc_id"), ns).drop("rank")
    found = cut_to_each_n(results.select("query_id", "rank", "doc_id"), ns).drop("rank").withColumn("hit", F.lit(1))
    return (
        wanted.join(found, ["n", "query_id", "doc_id"], "left")
        .groupBy("n")
        .agg((F.count("hit") / F.count("*")).alias("recall"))
    )


def with_metadata(results: DataFrame, metadata: DataFrame, key: str = "doc_id") -> DataFrame:
    """Results with their metadata; nulls where there is none."""
    return results.join(metadata, key, "left")
