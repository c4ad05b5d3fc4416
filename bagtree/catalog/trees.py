"""Trees, descent and the inverted index."""

from __future__ import annotations

from pyspark.sql import functions as F

from bagtree.catalog import sql
from bagtree.catalog.data import DIM, SHAPE, picture_features, pictures, table
from bagtree.catalog.registry import query
from bagtree.operators.postings import docs_count_of, postings_of, term_idf, term_stats_of
from bagtree.operators.quantize import quantize
from bagtree.operators.tree import TreeShape, frontier_nodes, leaf_nodes, root_nodes, train
from bagtree.sources.codec import export_features, export_nodes, import_features, import_nodes
from bagtree.sources.scratch import stage

_TREE = [sql.PICTURES, *sql.tree("pics")]
_POSTINGS = [*_TREE, *sql.postings("tree_leaves")]


def _centroid_sum(column="centroid"):
    return F.round(F.aggregate(column, F.lit(0.0), lambda acc, x: acc + x.cast("double")), 4).alias("centroid_sum")


@query(
    sql.with_ctes(
        _TREE, "SELECT term_id, parent_id, depth, n_features, round(list_sum(c), 4) AS centroid_sum FROM tree_nodes"
    )
)
def tree_two_levels(spark, sf_dir):
    """Nodes of a tree trained here and now: the zero root, children from level-wise k-means."""
    tree = train(picture_features(spark, sf_dir), "ims", SHAPE, DIM)
    return tree.nodes.select("term_id", "parent_id", "depth", "n_features", _centroid_sum())


@query(sql.with_ctes(_TREE, "SELECT term_id, doc_id, pos FROM tree_leaves"))
def tree_assignments(spark, sf_dir):
    """Each feature at its leaf."""
    return pictures(spark, sf_dir).tree.assignments.select("term_id", "doc_id", "pos")


_LEAVES = "SELECT * FROM tree_nodes n WHERE NOT EXISTS (SELECT 1 FROM tree_nodes c WHERE c.parent_id = n.term_id)"


@query(sql.with_ctes(_TREE, f"SELECT term_id, depth, n_features FROM ({_LEAVES})"))
def tree_leaves(spark, sf_dir):
    return leaf_nodes(pictures(spark, sf_dir).tree.nodes).select("term_id", "depth", "n_features")


@query(sql.with_ctes(_TREE, f"SELECT term_id, n_features FROM ({_LEAVES}) WHERE depth < 3 AND n_features >= 32"))
def tree_frontier(spark, sf_dir):
    """Leaves that one more level would split."""
    worthy = frontier_nodes(pictures(spark, sf_dir).tree.nodes, TreeShape(k=4, levels=3, min_samples=32))
    return worthy.select("term_id", "n_features")


_TREES = """(SELECT 'tree-' || event_id AS tree_id, CASE WHEN event_type = 'error' THEN 'training' ELSE 'ready' END AS state
            FROM events)"""


@query(f"SELECT tree_id, '0' AS term_id FROM {_TREES} WHERE state <> 'training'")
def tree_roots(spark, sf_dir):
    """Roots of the trees that are not in training. Every event registers a tree with a root and one child."""
    events = table(spark, sf_dir, "events")
    tree_id = F.concat(F.lit("tree-"), F.col("event_id").cast("string")).alias("tree_id")
    trees = events.select(tree_id, F.when(F.col("event_type") == "error", "training").otherwise("ready").alias("state"))
    depth = F.explode(F.array(F.lit(0), F.lit(1))).alias("depth")
    nodes = events.select(tree_id, depth).withColumn("term_id", F.when(F.col("depth") == 0, "0").otherwise("0.0"))
    return root_nodes(nodes, trees).select("tree_id", "term_id")


@query()
def tree_default_shape(spark, sf_dir):
    """A tree of the default shape (10 clusters, 6 levels, 100 features, k-means++): nodes per level."""
    tree = train(picture_features(spark, sf_dir), "default", TreeShape(), DIM)
    return tree.nodes.groupBy("depth").agg(F.count("*").alias("nodes"), F.sum("n_features").alias("features"))


@query(
    """SELECT count(*) AS root_features, count(*) AS leaf_features, 10 AS root_children, 0 AS orphans, 0 AS unequal_sums, 0 AS unsplit,
       0 AS split_too_small, 0 AS too_wide, 0 AS too_deep, 0 AS elsewhere FROM embeddings"""
)
def tree_default_invariants(spark, sf_dir):
    """What holds of every tree of the default shape: each node has its parent, children share out their parent's features, nodes are split
    from 100 features and above level 6, into at most ten, and a descent leads each feature to its leaf."""
    features = stage(picture_features(spark, sf_dir), "features")
    shape = TreeShape()
    tree = train(features, "default", shape, DIM)
    nodes, leaves = tree.nodes, stage(tree.assignments, "leaves")
    of = nodes.groupBy(F.col("parent_id").alias("term_id")).agg(F.count("*").alias("children"), F.sum("n_features").alias("below"))
    joined = stage(nodes.join(of, "term_id", "left"), "joined")
    inner, worthy = F.col("children").isNotNull(), (F.col("n_features") >= shape.min_samples) & (F.col("depth") < shape.levels)
    count = lambda condition, name: F.count(F.when(condition, 1)).cast("int").alias(name)
    parents = nodes.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("term_id")).distinct()
    found = joined.agg(
        F.max(F.when(F.col("depth") == 0, F.col("n_features"))).alias("root_features"),
        F.max(F.when(F.col("depth") == 0, F.col("children"))).cast("int").alias("root_children"),
        count(inner & (F.col("below") != F.col("n_features")), "unequal_sums"),
        count(~inner & worthy, "unsplit"),
        count(inner & ~worthy, "split_too_small"),
        count(F.col("children") > shape.k, "too_wide"),
        count(F.col("depth") > shape.levels, "too_deep"),
    )
    reached = quantize(features, nodes.drop("tree_id")).select("doc_id", "pos", F.col("term_id").alias("reached"))
    elsewhere = leaves.join(reached, ["doc_id", "pos"], "left").filter(~F.col("reached").eqNullSafe(F.col("term_id")))
    orphans = parents.join(nodes, "term_id", "left_anti")
    rows = lambda df, name, kind: df.agg(F.count("*").cast(kind).alias(name)).scalar().alias(name)
    return found.select(
        "*", rows(leaves, "leaf_features", "bigint"), rows(orphans, "orphans", "int"), rows(elsewhere, "elsewhere", "int")
    )


_DESCENT = [*_TREE, *sql.descend("pics", "doc_id", "tree_nodes", "reached")]


@query(sql.with_ctes(_DESCENT, "SELECT doc_id, pos, term_id FROM reached"))
def quantize_paths(spark, sf_dir):
    """The leaf that each vector reaches from the root; its id is the path."""
    built = pictures(spark, sf_dir)
    return quantize(built.features, built.index.nodes).select("doc_id", "pos", "term_id")


@query(sql.with_ctes(_DESCENT, "SELECT doc_id, pos, term_id FROM reached"))
def quantize_paths_by_join(spark, sf_dir):
    """The same for a tree too large to broadcast: only the first level is, the rest are salted joins."""
    built = pictures(spark, sf_dir)
    reached = quantize(built.features, built.index.nodes, max_codebook_bytes=4 * DIM * 4, rows_per_salt=50)
    return reached.select("doc_id", "pos", "term_id")


@query(sql.with_ctes(_POSTINGS, "SELECT term_id, doc_id, tf FROM post"))
def postings_tf(spark, sf_dir):
    """How often each document is in each node."""
    return postings_of(pictures(spark, sf_dir).tree.assignments).select("term_id", "doc_id", "tf")


@query(sql.with_ctes(_POSTINGS, "SELECT term_id, df, total_tf FROM post_stats"))
def term_stats(spark, sf_dir):
    return term_stats_of(pictures(spark, sf_dir).index.postings)


@query("SELECT count(DISTINCT vec_id // 5) AS docs_count FROM embeddings")
def tree_doc_count(spark, sf_dir):
    return docs_count_of(picture_features(spark, sf_dir).select("doc_id").distinct())


@query(
    sql.with_ctes(
        _POSTINGS,
        """SELECT term_id, df, total_tf, round(ln((1 + (SELECT count(DISTINCT doc_id) FROM pics)) / (1 + df)), 6) AS idf
           FROM post_stats""",
    )
)
def term_idfs(spark, sf_dir):
    index = pictures(spark, sf_dir).index
    return term_idf(index.term_stats, index.total_docs()).withColumn("idf", F.round("idf", 6))


@query(
    sql.with_ctes(
        _TREE,
        """SELECT n.term_id, n.depth, round(list_sum(n.c), 4) AS centroid_sum,
           coalesce((SELECT string_agg(c.term_id, ',' ORDER BY c.term_id) FROM tree_nodes c WHERE c.parent_id = n.term_id), '')
           AS children FROM tree_nodes n""",
    )
)
def node_json_roundtrip(spark, sf_dir):
    """Nodes written as JSON text and read back."""
    nodes = import_nodes(export_nodes(pictures(spark, sf_dir).tree.nodes))
    return nodes.select("term_id", "depth", _centroid_sum(), F.array_join("children", ",").alias("children"))


@query(sql.with_ctes(_TREE, "SELECT term_id, doc_id, pos, round(list_sum(v), 4) AS centroid_sum FROM tree_leaves"))
def feature_json_roundtrip(spark, sf_dir):
    """Features written as JSON text and read back."""
    features = import_features(export_features(pictures(spark, sf_dir).tree.assignments), "bigint")
    return features.select("term_id", "doc_id", "pos", _centroid_sum("vec"))
