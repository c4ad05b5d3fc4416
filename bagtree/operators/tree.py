"""Growing a vocabulary tree level by level, and the node predicates."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagtree.functions.paths import ROOT, child_term, depth_of, parent_term
from bagtree.functions.vectors import zero_vector
from bagtree.operators import cluster
from bagtree.sources.scratch import path_exists, scratch_path, stage

# The tree shape recommended for vocabulary trees.
CLUSTERS = 10
LEVELS = 6
MIN_SAMPLES = 100

NODE_SCHEMA = "tree_id string, term_id string, parent_id string, depth int, centroid array<float>, n_features long"

# If the next level may have more clusters than this, rows are stored in order of their nodes: a partition then
# meets few nodes, and its partial sums stay few.
_ORDER_ROWS_ABOVE = 10_000

# A node whose vectors take no more than this is clustered whole by one task.
WHOLE_NODE_BYTES = 16 << 20


@dataclass(frozen=True)
class TreeShape:
    k: int = CLUSTERS
    levels: int | None = LEVELS
    min_samples: int = MIN_SAMPLES
    iters: int = cluster.MAX_ROUNDS
    init: str = "kmeans||"
    salt: str = "seed"
    max_codebook_bytes: int = cluster.DEFAULT_CODEBOOK_BYTES
    order_rows_above: int = _ORDER_ROWS_ABOVE
    whole_node_bytes: int = WHOLE_NODE_BYTES


@dataclass(frozen=True)
class Tree:
    """``nodes`` as in NODE_SCHEMA; ``assignments`` (tree_id, term_id, doc_id, pos, vec), each feature at its leaf."""

    tree_id: str
    nodes: DataFrame
    assignments: DataFrame


def split(
    rows: DataFrame, frontier: cluster.Frontier, dim: int, shape: TreeShape, into: str | None = None
) -> tuple[DataFrame, DataFrame, list]:
    """Split all nodes of the frontier once. ``rows`` holds the rows of these nodes and no others.

    Returns the rows with their child's term, the children as (term_id, parent_id, depth, centroid, n_features),
    and the children's (term_id, size) list. The rows are a written table: in the folder ``into`` if one is given.
    """
    spark = rows.sparkSession
    most = shape.whole_node_bytes // (dim * 4)
    whole = [(term, n) for term, n in frontier if n <= most]
    crowded = [(term, n) for term, n in frontier if n > most]
    parts, centroids = [], []
    columns = ["term_id", "doc_id", "pos", "vec", "centroid"]
    no_centroid = F.lit(None).cast("array<float>").alias("centroid")
    # Crowded nodes: passes over all their rows, a block of nodes after the other.
    centroid_path = scratch_path(spark, "centroids")
    for block in cluster.blocks_of(crowded, shape.k, dim, shape.max_codebook_bytes):
        own = cluster.rows_of(rows, block) if len(block) < len(frontier) else rows
        book = cluster.fit(own, block, shape.k, dim, shape.iters, shape.init, shape.salt, shape.max_codebook_bytes)
        child = child_term(F.col("term_id"), F.col("cluster")).alias("term_id")
        parts.append(cluster.assign(own, book).select(child, "doc_id", "pos", "vec", no_centroid))
        spark.createDataFrame(cluster.codebook_table(book)).write.mode("append").parquet(centroid_path)
    if crowded:
        centroids.append(spark.read.schema("term_id string, parent_id string, centroid array<float>").parquet(centroid_path))
    # All others: one exchange, a task each.
    if whole:
        own = cluster.rows_of(rows, whole) if crowded else rows
        parts.append(cluster.split_whole_nodes(own, shape.k, dim, shape.iters, shape.init, shape.salt).select(*columns))
    moved = reduce(DataFrame.unionAll, parts)
    if len(frontier) * shape.k * shape.k > shape.order_rows_above:
        # The range goes on into document and position, so a node with very many rows spreads over partitions.
        moved = moved.repartitionByRange("term_id", "doc_id", "pos")
    if into is None:
        moved = stage(moved, "level")
    else:
        moved.write.mode("overwrite").parquet(into)
        moved = spark.read.schema(moved.schema).parquet(into)
    counts = moved.groupBy("term_id").count().toArrow().rename_columns(["term_id", "n_features"])
    sizes = sorted(zip(counts.column(0).to_pylist(), counts.column(1).to_pylist()))
    if whole:
        found = moved.filter(F.col("centroid").isNotNull())
        centroids.append(found.select("term_id", parent_term(F.col("term_id")).alias("parent_id"), "centroid"))
    moved = moved.select("term_id", "doc_id", "pos", "vec")
    children = reduce(DataFrame.unionAll, centroids).join(spark.createDataFrame(counts), "term_id").select(
        "term_id", "parent_id", depth_of(F.col("term_id")).alias("depth"), "centroid", "n_features"
    )
    return moved, children, sizes


def split_worthy(sizes: cluster.Frontier, shape: TreeShape) -> list:
    """The frontier predicate: large enough and not at the last level."""
    return [
        (term, n)
        for term, n in sizes
        if n >= shape.min_samples and (shape.levels is None or term.count(".") < shape.levels)
    ]


def root_frame(spark, dim: int, n_features: int) -> DataFrame:
    return spark.range(1).select(
        F.lit(ROOT).alias("term_id"),
        F.lit(None).cast("string").alias("parent_id"),
        F.lit(0).alias("depth"),
        zero_vector(dim).alias("centroid"),
        F.lit(n_features).cast("long").alias("n_features"),
    )


class Progress:
    """Finished levels of a training in a folder that outlives the driver: rows, nodes, then a mark. A level without its mark is
    made again, over what there is of it."""

    def __init__(self, spark, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, level: int, part: str) -> str:
        return f"{self.folder}/level-{level:03d}/{part}"

    def finished(self, level: int) -> bool:
        return path_exists(self.spark, self.path(level, "finished"))

    def read(self, level: int, rows_schema, nodes_schema) -> tuple[DataFrame, DataFrame, list]:
        rows = self.spark.read.schema(rows_schema).parquet(self.path(level, "rows"))
        nodes = self.spark.read.schema(nodes_schema).parquet(self.path(level, "nodes"))
        sizes = nodes.select("term_id", "n_features").toArrow()
        return rows, nodes, sorted(zip(sizes.column(0).to_pylist(), sizes.column(1).to_pylist()))

    def finish(self, level: int, nodes: DataFrame) -> DataFrame:
        nodes.write.mode("overwrite").parquet(self.path(level, "nodes"))
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(self.path(level, "finished"))
        return self.spark.read.schema(nodes.schema).parquet(self.path(level, "nodes"))


def train(
    features: DataFrame, tree_id: str, shape: TreeShape = TreeShape(), dim: int | None = None, progress: Progress | None = None
) -> Tree:
    """Train a tree on features (doc_id, pos, vec).

    ``features`` is scanned once per round, so pass a stored table, not a plan that encodes text on the way.
    The driver keeps the open nodes and their sizes, and one block of centroids at a time. With ``progress`` every level is
    kept once it is finished, and a training that begins with finished levels goes on after them: the features and the
    shape must be those of its first run.
    """
    spark = features.sparkSession
    if dim is None:
        first = features.select(F.size("vec").alias("dim")).first()
        if first is None:
            raise ValueError("no features to take the dimension from: give dim")
        dim = first["dim"]
    total = features.count()
    rows = features.select(F.lit(ROOT).alias("term_id"), "doc_id", "pos", "vec")
    rows_schema, nodes_schema = rows.schema, root_frame(spark, dim, total).schema
    nodes, leaves, sizes, level = root_frame(spark, dim, total), None, [(ROOT, total)], 0
    while sizes:
        frontier = split_worthy(sizes, shape)
        if len(frontier) < len(sizes):
            at_leaf = cluster.rows_not_of(rows, frontier) if frontier else rows
            leaves = at_leaf if leaves is None else leaves.unionByName(at_leaf)
            rows = cluster.rows_of(rows, frontier) if frontier else rows
        if not frontier:
            break
        level += 1
        if progress is None:
            rows, children, sizes = split(rows, frontier, dim, shape)
        elif progress.finished(level):
            rows, children, sizes = progress.read(level, rows_schema, nodes_schema)
        else:
            rows, children, sizes = split(rows, frontier, dim, shape, progress.path(level, "rows"))
            children = progress.finish(level, children)
        nodes = nodes.unionByName(children)
    nodes = stage(nodes.select(F.lit(tree_id).alias("tree_id"), "*"), "nodes")
    return Tree(tree_id, nodes, leaves.select(F.lit(tree_id).alias("tree_id"), "term_id", "doc_id", "pos", "vec"))


def leaf_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes without children."""
    parents = nodes.filter("parent_id IS NOT NULL").select("tree_id", F.col("parent_id").alias("term_id")).distinct()
    return nodes.join(parents, ["tree_id", "term_id"], "left_anti")


def with_sizes(nodes: DataFrame, term_stats: DataFrame) -> DataFrame:
    """Nodes with ``n_features`` from the terms' totals: what lies at or below a node now, not when it was made."""
    totals = term_stats.select("term_id", F.col("total_tf").alias("_total"))
    return nodes.join(totals, "term_id", "left").select(
        *[F.coalesce("_total", c).alias(c) if c == "n_features" else F.col(c) for c in nodes.columns]
    )


def frontier_nodes(nodes: DataFrame, shape: TreeShape) -> DataFrame:
    """Leaves that a training round would split."""
    worthy = F.col("n_features") >= shape.min_samples
    if shape.levels is not None:
        worthy = worthy & (F.col("depth") < shape.levels)
    return leaf_nodes(nodes).filter(worthy)


def root_nodes(nodes: DataFrame, trees: DataFrame) -> DataFrame:
    """Roots of the trees that are not in training."""
    in_training = trees.filter("state = 'training'").select("tree_id")
    return nodes.filter("depth = 0").join(in_training, "tree_id", "left_anti")
