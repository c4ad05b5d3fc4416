"""Adding documents to a trained tree: new rows only, nothing is rewritten.

New documents bring new (term, document) pairs, and the children of a split leaf are new terms, so postings only
grow. A feature whose leaf was split gets a further assignment row at the child; rows at nodes that are no longer
leaves are history.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagtree.functions.paths import ROOT, depth_of
from bagtree.operators import cluster
from bagtree.operators.postings import postings_of, term_stats_of
from bagtree.operators.quantize import quantize
from bagtree.operators.tree import TreeShape, leaf_nodes, split, split_worthy
from bagtree.sources.scratch import stage


@dataclass(frozen=True)
class Growth:
    """New nodes, assignments and postings, what these add to the totals of terms, and the totals of all terms after it."""

    nodes: DataFrame
    assignments: DataFrame
    postings: DataFrame
    added_stats: DataFrame
    term_stats: DataFrame


def current_assignments(assignments: DataFrame, nodes: DataFrame) -> DataFrame:
    """Assignment rows at leaves."""
    return assignments.join(leaf_nodes(nodes).select("tree_id", "term_id"), ["tree_id", "term_id"], "left_semi")


def touched_leaves(placed: DataFrame) -> DataFrame:
    """(term_id, added): the leaves that new features reached, with their number."""
    return placed.groupBy("term_id").agg(F.count("*").alias("added"))


def merge_stats(*stats: DataFrame) -> DataFrame:
    """Totals of tables whose (term, document) pairs are distinct."""
    merged = stats[0]
    for more in stats[1:]:
        merged = merged.unionByName(more)
    return merged.groupBy("term_id").agg(F.sum("df").alias("df"), F.sum("total_tf").alias("total_tf"))


def append(
    features: DataFrame,
    tree_id: str,
    nodes: DataFrame,
    assignments: DataFrame,
    term_stats: DataFrame,
    shape: TreeShape = TreeShape(),
    until_stable: bool = False,
) -> Growth:
    """Place the features (doc_id, pos, vec) of new documents and split the leaves that have become too large.

    ``assignments`` holds rows at leaves only. One round of splits, or with ``until_stable`` as many as it takes.
    """
    dim = nodes.filter(F.col("term_id") == ROOT).select(F.size("centroid").alias("dim")).first()["dim"]
    placed = stage(quantize(features, nodes, shape.max_codebook_bytes).select("term_id", "doc_id", "pos", "vec"), "placed")
    postings = postings_of(placed)

    sizes = (
        touched_leaves(placed)
        .join(term_stats.select("term_id", "total_tf"), "term_id", "left")
        .select("term_id", (F.col("added") + F.coalesce("total_tf", F.lit(0))).alias("n"))
        .filter(F.col("n") >= shape.min_samples)
    )
    if shape.levels is not None:  # leaves of the last level stay in Spark, however many are full
        sizes = sizes.filter(depth_of(F.col("term_id")) < shape.levels)
    frontier = split_worthy(sorted((s["term_id"], s["n"]) for s in sizes.collect()), shape)
    at_leaf, new_nodes = None, None
    rows = placed.unionByName(assignments.select("term_id", "doc_id", "pos", "vec")) if frontier else None
    stay = placed
    while frontier:
        # Written once, as every round of the split reads these rows and no others of the tree.
        full = stage(cluster.rows_of(rows, frontier), "full_leaves")
        moved, children, sizes = split(full, frontier, dim, shape)
        kept = cluster.rows_not_of(stay, frontier)
        at_leaf = kept if at_leaf is None else at_leaf.unionByName(kept)
        postings = postings.unionByName(moved.groupBy("term_id", "doc_id").agg(F.count("*").alias("tf")))
        new_nodes = children if new_nodes is None else new_nodes.unionByName(children)
        rows = stay = moved
        frontier = split_worthy(sizes, shape) if until_stable else []
    at_leaf = stay if at_leaf is None else at_leaf.unionByName(stay)

    postings = stage(postings.select("term_id", "doc_id", "tf"), "postings")
    added = term_stats_of(postings)
    totals = merge_stats(term_stats.select("term_id", "df", "total_tf"), added)
    tree = F.lit(tree_id).alias("tree_id")
    if new_nodes is None:
        new_nodes = nodes.limit(0).drop("tree_id")
    return Growth(
        new_nodes.select(tree, "term_id", "parent_id", "depth", "centroid", "n_features"),
        at_leaf.select(tree, "term_id", "doc_id", "pos", "vec"),
        postings,
        added,
        totals,
    )
