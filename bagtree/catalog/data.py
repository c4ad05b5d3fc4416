"""What the given tables stand for in the catalogue.

A vector of ``embeddings`` is a picture descriptor; five in a row make one picture. A conversation is a captioned
picture, its turns are the captions; conversation c and picture c are the same item. ``benchmark`` texts are the
test captions, ``documents`` the metadata of items.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagtree.operators.encode import encode_text, hashed_words
from bagtree.operators.postings import docs_count_of, postings_of, term_stats_of
from bagtree.operators.search import Index
from bagtree.operators.tree import Tree, TreeShape, train
from bagtree.sources.scratch import stage

VECTORS_PER_PICTURE = 5
DIM = 64

# Small enough for the SQL twin: a level there is a page of text.
SHAPE = TreeShape(k=4, levels=2, min_samples=20, iters=1, init="hash")
# Terms of so flat a tree are wide; the default threshold of 0.05 suits deep ones.
THRESHOLD = 0.0003

# Leaves of a few captions, whatever the size of the table, as the default threshold wants them.
DEEP = TreeShape(k=4, levels=8, min_samples=8, iters=1, init="hash")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def picture_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.expr(f"vec_id div {VECTORS_PER_PICTURE}").alias("doc_id"),
        (F.col("vec_id") % VECTORS_PER_PICTURE).cast("int").alias("pos"),
        F.col("embedding").alias("vec"),
    )


def caption_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("pos"), "text"
    )
    return encode_text(turns, hashed_words(DIM)).drop("text")


def test_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lit(0).alias("pos"), "text")
    return encode_text(texts, hashed_words(DIM)).drop("text")


@dataclass(frozen=True)
class Built:
    features: DataFrame
    tree: Tree
    index: Index


def build_index(features: DataFrame, tree_id: str, shape: TreeShape) -> Built:
    """Features, tree and postings as written tables, as a training job leaves them."""
    features = stage(features, "features")
    tree = train(features, tree_id, shape, DIM)
    tree = Tree(tree_id, tree.nodes, stage(tree.assignments, "assignments"))
    postings = stage(postings_of(tree.assignments), "postings")
    stats = stage(term_stats_of(postings), "term_stats")
    count = docs_count_of(features.select("doc_id").distinct())
    return Built(features, tree, Index(tree.nodes.drop("tree_id"), postings, stats, stage(count, "docs_count")))


_built: dict[tuple[str, str, str], Built] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, features_of, shape: TreeShape = SHAPE) -> Built:
    """An index is trained once per session and then read by all queries, as a stored index is."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _built:
        _built[key] = build_index(features_of(spark, sf_dir), name, shape)
    return _built[key]


def pictures(spark: SparkSession, sf_dir: str) -> Built:
    return _once(spark, sf_dir, "ims", picture_features)


def captions(spark: SparkSession, sf_dir: str) -> Built:
    return _once(spark, sf_dir, "captions", caption_features)


def deep_captions(spark: SparkSession, sf_dir: str) -> Built:
    return _once(spark, sf_dir, "deep", caption_features, DEEP)
