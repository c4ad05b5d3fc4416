"""Top-n search of many queries at once over an index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bagtree.functions.weights import idf, normalised_tf
from bagtree.operators.cluster import DEFAULT_CODEBOOK_BYTES
from bagtree.operators.postings import term_counts
from bagtree.operators.quantize import quantize
from bagtree.sources.scratch import stage, unstage

# Fixed value: the smallest tf-idf weight with which a query term takes part.
TF_IDF_THRESHOLD = 0.05

# Up to this many query terms are named to the postings scan, which then skips row groups without them.
PUSHED_TERMS = 1000

# About this many matches are sorted by one task of a search, whatever the number of shuffle partitions.
ROWS_PER_TASK = 1 << 19

# Distances are compared at this many digits, so that sums in another order rank alike.
SCORE_DIGITS = 9

# How far two sums of the same numbers may lie apart.
_SLACK = 1e-14


@dataclass(frozen=True)
class Index:
    """One tree's tables: nodes, postings (term_id, doc_id, tf), term_stats (term_id, df, total_tf), docs_count.

    With ``blocks`` (see ``operators.blocks``), which all postings then name in a column ``block``, a search reads only the
    blocks of documents that can be among its answers.
    """

    nodes: DataFrame
    postings: DataFrame
    term_stats: DataFrame
    docs_count: DataFrame
    blocks: DataFrame | None = None

    def total_docs(self) -> Column:
        return self.docs_count.select("docs_count").scalar()


def query_terms(queries: DataFrame, nodes: DataFrame, max_codebook_bytes: int = DEFAULT_CODEBOOK_BYTES) -> DataFrame:
    """(query_id, pos, vec) -> (term_id, query_id, query_tf) over all nodes the query's vectors visit."""
    features = queries.select(F.col("query_id").alias("doc_id"), "pos", "vec")
    leaves = quantize(features, nodes, max_codebook_bytes).withColumnRenamed("doc_id", "query_id")
    return term_counts(leaves, "query_id", "query_tf")


def term_weights(terms: DataFrame, index: Index) -> DataFrame:
    """Adds idf, the total tf and the query's weight ``q_weight`` to each query term. A term without totals is an error."""
    total = F.col("total_tf")
    missing = F.raise_error(F.concat(F.lit("no totals of term "), F.col("term_id"))).cast("bigint")
    known = terms.join(index.term_stats, "term_id", "left").withColumn("total_tf", F.coalesce("total_tf", missing))
    return known.select(
        "query_id",
        "term_id",
        "query_tf",
        "df",
        "total_tf",
        idf(index.total_docs(), F.col("df")).alias("idf"),
        (normalised_tf(F.col("query_tf"), F.col("query_tf"), total) * idf(index.total_docs(), F.col("df"))).alias("q_weight"),
    )


def prune(weights: DataFrame, threshold: float = TF_IDF_THRESHOLD) -> DataFrame:
    """Drop weak query terms. A kept term has total_tf <= query_tf * (idf / threshold), which bounds its postings."""
    return weights.filter(F.col("q_weight") >= threshold)


def with_query_norm(kept: DataFrame) -> DataFrame:
    """Adds ``q_norm``, the sum of the query's weights. A query has at most one row per node of the tree."""
    return kept.withColumn("q_norm", F.sum("q_weight").over(Window.partitionBy("query_id")))


def dealt(rows: DataFrame, by: str, matches: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Rows with ``query_id`` and ``by``, about ``rows_per_task`` to a task: those of a query with the same ``by`` lie in the same ``slice``, a
    new column, and all of a query's slice in one task.

    ``matches`` (query_id, n) tells how many rows are to come. A query with more than a task takes is cut into slices by ``by``.
    """
    sizes = matches.groupBy("query_id").agg(F.sum("n").alias("n"))
    found = sizes.agg(F.sum("n").alias("total"), F.max("n").alias("most")).first()
    tasks = max(1, -(-(found["total"] or 0) // rows_per_task))
    if (found["most"] or 0) <= rows_per_task:
        return rows.repartition(tasks, "query_id").withColumn("slice", F.lit(0))
    # At most one in ``rows_per_task`` of the rows has its query here.
    slices = sizes.filter(F.col("n") > rows_per_task).select("query_id", F.ceil(F.col("n") / rows_per_task).alias("slices"))
    slice_ = F.pmod(F.xxhash64(by), F.coalesce("slices", F.lit(1))).cast("int")
    rows = rows.join(F.broadcast(slices), "query_id", "left").withColumn("slice", slice_).drop("slices")
    return rows.repartition(tasks, "query_id", "slice")


def postings_of_terms(postings: DataFrame, kept: DataFrame) -> DataFrame:
    """Postings, cut down by name to the terms in question if these are few."""
    terms = [row["term_id"] for row in kept.select("term_id").distinct().limit(PUSHED_TERMS + 1).collect()]
    return postings.filter(F.col("term_id").isin(terms)) if len(terms) <= PUSHED_TERMS else postings


def term_scores(kept: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, term_id, doc_id, q_weight, q_norm, d_weight) for all documents that share a kept term."""
    return kept.join(postings, "term_id").select(
        "query_id",
        "term_id",
        "doc_id",
        "q_weight",
        "q_norm",
        (normalised_tf(F.col("tf"), F.col("query_tf"), F.col("total_tf")) * F.col("idf")).alias("d_weight"),
    )


def open_blocks(kept: DataFrame, blocks: DataFrame, n: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(query_id, block): the blocks that can hold one of a query's n best documents, as a written table.

    Of each block and term the least and the largest tf are known, so least and largest document weights. A document's part in a
    term, d_t / sum(d), lies between the quotients with the one extreme above and the other below, and so does its similarity
    sum(min(q_t, d_t)) (the distance is 2 - 2 times that). The blocks with the best lower bounds that have n documents together
    give a bar for the n-th best; whatever has a lower upper bound is left closed. So is a block that can only draw level
    with the bar and whose documents all have larger ids than those n, as ties go to the lower id.

    One row per query, block and shared term is read, no posting. Each task passes on n blocks per query towards the bar.
    """
    weight = lambda tf: normalised_tf(F.col(tf), F.col("query_tf"), F.col("total_tf")) * F.col("idf")
    terms = kept.join(blocks, "term_id").select(
        "query_id",
        "block",
        "n_docs",
        "min_doc",
        "max_doc",
        (F.col("q_weight") / F.col("q_norm")).alias("q"),
        weight("max_tf").alias("most"),
        weight("min_tf").alias("least"),
    )
    of_term = blocks.groupBy("term_id").agg(F.count(F.lit(1)).alias("n"))
    terms = dealt(terms, "block", kept.select("query_id", "term_id").join(of_term, "term_id"), rows_per_task)
    of_block = Window.partitionBy("query_id", "slice", "block")
    others = terms.select(
        "*",
        (F.sum("least").over(of_block) - F.col("least")).alias("other_least"),
        (F.sum("most").over(of_block) - F.col("most")).alias("other_most"),
    )
    part = lambda own, other: F.when(F.col(own) > 0, F.col(own) / (F.col(own) + F.greatest(other, F.lit(0.0)))).otherwise(0.0)
    bounds = others.groupBy("query_id", "slice", "block").agg(
        F.sum(F.least("q", part("most", "other_least"))).alias("upper"),
        F.sum(F.least("q", part("least", "other_most"))).alias("lower"),
        F.max("n_docs").alias("n_docs"),
        F.max("min_doc").alias("min_doc"),
        F.max("max_doc").alias("max_doc"),
    )
    bounds = stage(bounds.drop("slice"), "bounds")
    best = Window.partitionBy("query_id").orderBy(F.desc("lower"), "max_doc", "block")
    near = bounds.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= n)
    before = F.coalesce(F.sum("n_docs").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = near.withColumn("before", before).filter(F.col("before") < n)
    # A query whose blocks have fewer than n documents keeps them all.
    bars = chosen.groupBy("query_id").agg(
        F.when(F.sum("n_docs") >= n, F.min("lower")).otherwise(F.lit(-1.0)).alias("bar"), F.max("max_doc").alias("last_doc")
    )
    # Written, the bars have a known size: while it is small they go to the bounds, which are many and need no exchange then.
    bars = stage(bars, "bars")
    level = (F.col("upper") <= F.col("bar") + F.lit(_SLACK)) & (F.col("min_doc") > F.col("last_doc"))
    fits = (F.col("upper") >= F.col("bar") - F.lit(_SLACK) - F.lit(10.0**-SCORE_DIGITS)) & ~level
    opened = stage(bounds.join(bars, "query_id").filter(fits).select("query_id", "block"), "open_blocks")
    unstage(bounds, bars)
    return opened


def terms_of_blocks(kept: DataFrame, blocks: DataFrame) -> DataFrame:
    """(query_id, n): how many kept terms a query's (query_id, block) pairs have together, one block counted after the other."""
    terms = kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("terms"))
    opened = blocks.groupBy("query_id").agg(F.count(F.lit(1)).alias("blocks"))
    return opened.join(terms, "query_id").select("query_id", (F.col("blocks") * F.col("terms")).alias("n"))


def term_scores_of_blocks(kept: DataFrame, index: Index, blocks: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``term_scores`` of the documents in the given (query_id, block) pairs. Few blocks are named to the postings scan."""
    named = [row["block"] for row in blocks.select("block").distinct().limit(PUSHED_TERMS + 1).collect()]
    postings = postings_of_terms(index.postings, kept)
    if len(named) <= PUSHED_TERMS:
        postings = postings.filter(F.col("block").isin(named))
    total = terms_of_blocks(kept, blocks).agg(F.sum("n")).first()[0] or 0
    tasks = max(1, -(-total // rows_per_task))
    wanted = kept.join(blocks, "query_id").repartition(tasks, "term_id", "block")
    postings = postings.repartition(tasks, "term_id", "block")
    return wanted.join(postings, ["term_id", "block"]).select(
        "query_id",
        "term_id",
        "doc_id",
        "q_weight",
        "q_norm",
        (normalised_tf(F.col("tf"), F.col("query_tf"), F.col("total_tf")) * F.col("idf")).alias("d_weight"),
    )


def distances(scores: DataFrame) -> DataFrame:
    """(query_id, doc_id, distance): L1 distance of the L1-normalised weight vectors.

    ``scores`` has the sum of the query's weights as ``q_norm``. Both vectors are non-negative with sum 1, hence
    |q - d| = 2 - 2 * sum(min(q, d)) and only shared terms count. The document's sum and the final sum use the same
    keys, so there is one exchange for both; a group has at most one row per kept term of the query. Scores that are ``dealt`` by
    document stay where they are.
    """
    pair = ["query_id", "slice", "doc_id"] if "slice" in scores.columns else ["query_id", "doc_id"]
    of_pair = Window.partitionBy(*pair)
    normed = scores.withColumn("d_norm", F.sum("d_weight").over(of_pair))
    shared = F.least(F.col("q_weight") / F.col("q_norm"), F.col("d_weight") / F.col("d_norm"))
    by_pair = normed.groupBy(*pair).agg((F.lit(2.0) - F.lit(2.0) * F.sum(shared)).alias("distance"))
    return by_pair.select("query_id", "doc_id", "distance")


def top_n(scored: DataFrame, n: int, by: Column) -> DataFrame:
    """Rows ranked from 1 per query, ties by doc_id; each map task passes on at most n rows per query."""
    order = Window.partitionBy("query_id").orderBy(by, "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def search(
    queries: DataFrame,
    index: Index,
    n: int,
    threshold: float = TF_IDF_THRESHOLD,
    exclude_self: bool = False,
    max_codebook_bytes: int = DEFAULT_CODEBOOK_BYTES,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """The n nearest documents per query: (query_id, rank, doc_id, distance).

    ``queries`` is (query_id, pos, vec). ``exclude_self`` is for queries that are documents of the index. A query
    without a kept term has no rows, one that shares its terms with fewer than n documents has fewer than n.
    """
    kept = with_query_norm(prune(term_weights(query_terms(queries, index.nodes, max_codebook_bytes), index), threshold))
    # As a written table the kept terms have a known size: while small they are broadcast to the postings, which then
    # need no exchange.
    kept = stage(kept, "kept")
    if index.blocks is None:
        scores = term_scores(kept, postings_of_terms(index.postings, kept))
        matches = kept.select("query_id", F.col("df").alias("n"))
    else:
        opened = open_blocks(kept, index.blocks, n + exclude_self, rows_per_task)
        scores = term_scores_of_blocks(kept, index, opened, rows_per_task)
        largest = index.blocks.agg(F.max("n_docs")).first()[0] or 0
        matches = terms_of_blocks(kept, opened).withColumn("n", F.col("n") * largest)
    scored = distances(dealt(scores.drop("term_id"), "doc_id", matches, rows_per_task))
    if exclude_self:
        scored = scored.filter(F.col("doc_id") != F.col("query_id"))
    scored = scored.withColumn("distance", F.round("distance", SCORE_DIGITS))
    return top_n(scored, n, F.col("distance")).select("query_id", "rank", "doc_id", "distance")
