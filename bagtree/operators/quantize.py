"""Features to tree leaves."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagtree.functions import kernels
from bagtree.functions.kernels import TreeTable
from bagtree.functions.paths import ROOT
from bagtree.functions.paths import child_term
from bagtree.operators import cluster
from bagtree.operators.cluster import DEFAULT_CODEBOOK_BYTES
from bagtree.sources.scratch import stage

# Rows of one node beyond which they do not go to one task of a join.
ROWS_PER_SALT = 1_000_000


def quantize(
    features: DataFrame,
    nodes: DataFrame,
    max_codebook_bytes: int = DEFAULT_CODEBOOK_BYTES,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Adds ``term_id``, the leaf each ``vec`` reaches; its path id names all visited nodes.

    ``nodes`` holds one tree. As many upper levels as fit the bound are broadcast and walked in one pass without
    a shuffle; each deeper level is an equi join of the rows with the children of their node. Before it the rows are counted by
    node: those of crowded nodes, beyond ``rows_per_salt``, stay where they are and meet their children by broadcast, as far as these fit
    the bound, and are dealt over several tasks beyond it.
    """
    levels = nodes.groupBy("depth").agg(F.count("*").alias("n"), F.max(F.size("centroid")).alias("dim")).orderBy("depth").collect()
    if not levels:
        raise ValueError("the tree has no root")
    dim = levels[0]["dim"]
    fit, used = 0, 0
    for level in levels[1:]:
        used += level["n"] * dim * 4
        if used > max_codebook_bytes:
            break
        fit = level["depth"]
    upper = nodes.filter(F.col("depth") <= fit).select("term_id", "parent_id", "centroid").toArrow()
    shared = features.sparkSession.sparkContext.broadcast(tuple(tree_table(upper, dim)))
    out = features.withColumn("term_id", kernels.descend_udf(shared, dim)("vec"))
    for depth in range(fit, levels[-1]["depth"]):
        out = _descend_one(out, nodes.filter(F.col("depth") == depth + 1), dim, rows_per_salt, max_codebook_bytes)
    return out


def _descend_one(rows: DataFrame, children: DataFrame, dim: int, rows_per_salt: int, max_codebook_bytes: int) -> DataFrame:
    """One level down, rows at nodes without children staying."""
    rows = stage(rows, "placed")
    # At most one in ``rows_per_salt`` of the rows has its node here.
    counts = rows.groupBy("term_id").count().filter(F.col("count") > rows_per_salt).collect()
    if not counts:
        return _descend_by_join(rows, children, dim, [], rows_per_salt)
    widest = children.agg(F.max(_cluster_number(F.col("term_id")))).first()[0]
    fit = max_codebook_bytes // ((1 + (widest or 0)) * dim * 4)
    by_size = sorted(((r["term_id"], r["count"]) for r in counts), key=lambda c: (-c[1], c[0]))
    near, salted = sorted(by_size[:fit]), by_size[fit:]
    if not near:
        return _descend_by_join(rows, children, dim, salted, rows_per_salt)
    own = children.filter(F.col("parent_id").isin([term for term, _ in near])) if len(near) <= 1000 else children.join(
        cluster.frontier_frame(rows.sparkSession, near).select(F.col("term_id").alias("parent_id")), "parent_id", "left_semi"
    )
    found = own.select(F.col("parent_id").alias("term_id"), _cluster_number(F.col("term_id")).alias("cluster"), "centroid").toArrow()
    book = cluster.to_codebook(found, 1 + (widest or 0), dim)
    shared = rows.sparkSession.sparkContext.broadcast(tuple(book))
    crowded = cluster.rows_of(rows, near).withColumn("nearest", kernels.assign_udf(shared)("term_id", "vec"))
    below = F.when(F.col("nearest").isNull(), F.col("term_id")).otherwise(child_term(F.col("term_id"), F.col("nearest")))
    crowded = crowded.withColumn("term_id", below).select(*rows.columns)
    return crowded.unionByName(_descend_by_join(cluster.rows_not_of(rows, near), children, dim, salted, rows_per_salt))


def _descend_by_join(rows: DataFrame, children: DataFrame, dim: int, crowded: list, rows_per_salt: int) -> DataFrame:
    """One level down. All children of a node come as one array, so the join keeps one row per feature. ``crowded`` nodes, with their
    numbers of rows, are dealt over several tasks."""
    # At most k children per node, in the order of their numbers.
    packed = (
        children.groupBy(F.col("parent_id").alias("term_id"))
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(_cluster_number(F.col("term_id")).alias("cluster"), "centroid", F.col("term_id").alias("child"))
                )
            ).alias("children"),
        )
        .select("term_id", F.col("children.child").alias("child"), F.flatten("children.centroid").alias("centroids"))
    )
    if not crowded:
        joined = rows.join(packed, "term_id", "left")
    else:
        # Rows of a crowded node are spread over ``salts`` tasks; its children are repeated as often.
        number = F.floor(F.col("node_n") / rows_per_salt).cast("int") + 1
        salts = cluster.frontier_frame(rows.sparkSession, crowded).select("term_id", number.alias("salts"))
        salted = rows.join(F.broadcast(salts), "term_id", "left").withColumn(
            "salt", F.pmod(F.xxhash64("vec", "doc_id", "pos"), F.coalesce("salts", F.lit(1))).cast("int")
        )
        repeated = packed.join(salts, "term_id", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
        joined = salted.drop("salts").join(repeated.drop("salts"), ["term_id", "salt"], "left")
    return (
        joined.withColumn("nearest", kernels.nearest_of_udf(dim)("vec", "centroids"))
        .withColumn("term_id", F.coalesce(F.get("child", F.col("nearest")), F.col("term_id")))
        .select(*rows.columns)
    )


def _cluster_number(term):
    return F.element_at(F.split(term, "[.]"), -1).cast("int")


def tree_table(nodes: pa.Table, dim: int) -> TreeTable:
    """(term_id, parent_id, centroid) rows, the root among them, as arrays for descent."""
    number = [int(term.rsplit(".", 1)[-1]) for term in nodes.column("term_id").to_pylist()]
    terms = nodes.column("term_id").to_pylist()
    order = sorted(range(len(terms)), key=lambda i: (terms[i] != ROOT, terms[i]))
    terms = [terms[i] for i in order]
    index = {term: i for i, term in enumerate(terms)}
    parents = nodes.column("parent_id").to_pylist()
    inner_terms = sorted({p for p in parents if p is not None}, key=index.__getitem__)
    inner_row = {term: i for i, term in enumerate(inner_terms)}
    inner = np.full(len(terms), -1, dtype=np.int64)
    for term, row in inner_row.items():
        inner[index[term]] = row
    slots = max((number[i] + 1 for i in order if parents[i] is not None), default=1)
    children = np.full((len(inner_terms), slots), -1, dtype=np.int64)
    centroids = np.full((len(inner_terms), slots, dim), np.inf, dtype=np.float32)
    matrix = kernels.vector_matrix(nodes.column("centroid"), dim)
    for position, i in enumerate(order):
        if parents[i] is not None:
            children[inner_row[parents[i]], number[i]] = position
            centroids[inner_row[parents[i]], number[i]] = matrix[i]
    return TreeTable(pa.array(terms, pa.string()), inner, children, centroids)
