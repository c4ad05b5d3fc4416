"""Exact search that passes over parts of a tree by the triangle inequality.

Every leaf is a ball: the leaf's centre and the largest angle between it and a vector at the leaf. An inner node's ball holds those of
its leaves. With theta the angle between a query and a centre and rho the ball's radius, no cosine in the ball exceeds
cos(theta - rho).

Each query first looks at the leaves nearest to it, whose n-th best document is its bar. Then it goes down the tree: a node
whose bound is below the bar is passed over with all that lies beneath. Only rows of leaves that stay open to a query are compared with it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bagtree.functions import kernels
from bagtree.functions.paths import depth_of
from bagtree.operators.cluster import DEFAULT_CODEBOOK_BYTES
from bagtree.operators.evaluate import MAX_N, QUERY_BLOCK_BYTES
from bagtree.operators.search import SCORE_DIGITS, top_n
from bagtree.sources.scratch import stage, unstage

# What rounding may add to an angle's cosine, and how many queries a row is sent along with.
_SLACK = 1e-7
_QUERIES_PER_LIST = 128


def leaf_balls(assignments: DataFrame, nodes: DataFrame) -> DataFrame:
    """(term_id, centre, radius, n_docs, n_rows) of the leaves that hold vectors (term_id, doc_id, vec). To be stored beside them."""
    centres = nodes.select("term_id", F.col("centroid").alias("centre"))
    angle = kernels.angle_udf()(F.col("vec").cast("array<double>"), F.col("centre").cast("array<double>"))
    angles = assignments.join(centres, "term_id").select("term_id", "doc_id", angle.alias("angle"))
    # First per document, so a crowded leaf is counted in parts.
    per_doc = angles.groupBy("term_id", "doc_id").agg(F.max("angle").alias("angle"), F.count("*").alias("n"))
    sizes = per_doc.groupBy("term_id").agg(F.max("angle").alias("radius"), F.count("*").alias("n_docs"), F.sum("n").alias("n_rows"))
    return sizes.join(centres, "term_id").select("term_id", "centre", "radius", "n_docs", "n_rows")


def upper_balls(balls: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """(term_id, centre, radius) of the nodes at ``depth`` (and leaves above it): they hold the balls of their leaves."""
    centres = nodes.select(F.col("term_id").alias("upper_id"), F.col("centroid").alias("upper_centre"))
    below = balls.withColumn("upper_id", _ancestor(depth)).join(centres, "upper_id")
    angle = kernels.angle_udf()(F.col("centre").cast("array<double>"), F.col("upper_centre").cast("array<double>"))
    reach = below.select("upper_id", F.least(angle + F.col("radius"), F.lit(float(np.pi))).alias("radius"))
    radii = reach.groupBy("upper_id").agg(F.max("radius").alias("radius"))
    return radii.join(centres, "upper_id").select(F.col("upper_id").alias("term_id"), F.col("upper_centre").alias("centre"), "radius")


def _ancestor(depth: int):
    return F.substring_index("term_id", ".", depth + 1)


def _upper_depth(nodes: DataFrame, dim: int, max_bytes: int) -> int:
    """The deepest level above the last one whose centres fit the bound."""
    sizes = nodes.groupBy(depth_of(F.col("term_id")).alias("depth")).count().orderBy("depth").collect()
    fit = [r["depth"] for r in sizes if r["count"] * dim * 8 <= max_bytes]
    return max(0, min(max(fit, default=0), len(sizes) - 2))


def exact_topk_by_tree(
    assignments: DataFrame,
    nodes: DataFrame,
    queries: DataFrame,
    n: int = MAX_N,
    balls: DataFrame | None = None,
    block_bytes: int = QUERY_BLOCK_BYTES,
    max_codebook_bytes: int = DEFAULT_CODEBOOK_BYTES,
    compared: list[int] | None = None,
) -> DataFrame:
    """(query_id, rank, doc_id, similarity), equal to ``evaluate.exact_topk`` over the same vectors.

    ``assignments`` is (term_id, doc_id, vec), each vector at its leaf; ``balls`` what ``leaf_balls`` gives for them, made here if not
    stored. Queries (query_id, vec) come in blocks of bounded size. ``compared``, if given, gets the number of (vector, query)
    comparisons of both rounds, per block.
    """
    spark = assignments.sparkSession
    shape = queries.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim")).first()
    if not shape["n"]:
        raise ValueError("no queries")
    dim = shape["dim"]
    own_balls = None if balls is not None else stage(leaf_balls(assignments, nodes), "balls")
    balls = own_balls if balls is None else balls
    depth = _upper_depth(nodes, dim, max_codebook_bytes)
    upper = upper_balls(balls, nodes, depth).toArrow()
    terms = upper.column("term_id").combine_chunks().cast(pa.string())
    upper_centres = kernels._unit(kernels.vector_matrix(upper.column("centre"), dim).astype(np.float64))
    upper_radius = upper.column("radius").to_numpy()

    per_block = max(1, block_bytes // (dim * 8))
    blocks = -(-shape["n"] // per_block)
    types = [f"{name} {df.schema[name].dataType.simpleString()}" for name, df in (("query_id", queries), ("doc_id", assignments))]
    schema = f"{types[0]}, {types[1]}, similarity double"
    rows = assignments.select("term_id", "doc_id", "vec")
    answers = None
    for block in range(blocks):
        part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        table = part.select("query_id", "vec").toArrow()
        if not table.num_rows:
            continue
        ids = table.column("query_id").combine_chunks()
        matrix = kernels._unit(kernels.vector_matrix(table.column("vec"), dim).astype(np.float64))
        held = []

        def share(value):
            held.append(spark.sparkContext.broadcast(value))
            return held[-1]

        def verified(lists: DataFrame, bars: np.ndarray, name: str) -> DataFrame:
            lists = stage(lists, "lists")
            if compared is not None:
                pairs = lists.join(balls.select("term_id", "n_rows"), "term_id").agg(F.sum(F.size("queries") * F.col("n_rows"))).first()[0]
                compared.append(int(pairs or 0))
            kernel = kernels.best_of_lists(share((ids, matrix, bars)), n, SCORE_DIGITS)
            found = rows.join(lists, "term_id").select("doc_id", "vec", "queries").mapInArrow(kernel, schema)
            best = stage(top_n(found.groupBy("query_id", "doc_id").agg(F.max("similarity").alias("similarity")), n, F.col("similarity").desc()), name)
            unstage(lists)
            return best

        near = balls.select("term_id", "centre", "n_docs").mapInArrow(
            kernels.nearest_balls(share(matrix), 2 * n), "query long, term_id string, cosine double, n_docs long"
        )
        order = Window.partitionBy("query").orderBy(F.desc("cosine"), "term_id")
        near = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= 2 * n)
        before = F.coalesce(F.sum("n_docs").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        seeds = near.withColumn("before", before).filter(F.col("before") < 2 * n)
        listed = seeds.groupBy("term_id", (F.col("query") / _QUERIES_PER_LIST).cast("long").alias("part")).agg(
            F.collect_list(F.col("query").cast("int")).alias("queries")  # at most _QUERIES_PER_LIST
        )
        first = verified(listed.select("term_id", "queries"), np.full(len(matrix), -1.0), "first")
        # The n-th best of the first look; a query that has found fewer goes through all.
        last = first.filter(F.col("rank") == n).select("query_id", "similarity").toArrow()
        bars = np.full(len(matrix), -1.0)
        if last.num_rows:
            place = pc.index_in(last.column("query_id"), value_set=ids).to_numpy()
            bars[place] = last.column("similarity").to_numpy()
        shared = share((matrix, bars, terms, upper_centres, upper_radius))
        lists = balls.select("term_id", _ancestor(depth).alias("upper_id"), "centre", "radius").mapInArrow(
            kernels.open_balls(shared, _SLACK, _QUERIES_PER_LIST), "term_id string, queries array<int>"
        )
        found = verified(lists, bars, "found")
        unstage(first)
        for value in held:
            value.destroy()
        answers = found if answers is None else answers.unionByName(found)
    if own_balls is not None:
        unstage(own_balls)
    return answers.select("query_id", "rank", "doc_id", "similarity")
