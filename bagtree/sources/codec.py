"""Nodes and features as JSON text, for import and export. Inside, nested values stay arrays and structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VECTOR = "array<float>"
FEATURES = "array<struct<doc_id: string, vec: array<float>>>"


def to_json_text(value: Column) -> Column:
    return F.to_json(value)


def from_json_text(text: Column, schema: str) -> Column:
    return F.from_json(text, schema)


def export_nodes(nodes: DataFrame) -> DataFrame:
    """(tree_id, term_id, depth, vec, children) with vec and children as JSON text.

    Features are exported apart (``export_features``): a node may hold any number of them.
    """
    children = (
        nodes.filter("parent_id IS NOT NULL")
        .groupBy("tree_id", F.col("parent_id").alias("term_id"))
        .agg(F.array_sort(F.collect_list("term_id")).alias("children"))
    )
    return nodes.join(children, ["tree_id", "term_id"], "left").select(
        "tree_id",
        "term_id",
        "depth",
        to_json_text(F.col("centroid")).alias("vec"),
        to_json_text(F.coalesce("children", F.array().cast("array<string>"))).alias("children"),
    )


def import_nodes(exported: DataFrame) -> DataFrame:
    """(tree_id, term_id, depth, centroid, children) from the exported text."""
    return exported.select(
        "tree_id",
        "term_id",
        "depth",
        from_json_text(F.col("vec"), VECTOR).alias("centroid"),
        from_json_text(F.col("children"), "array<string>").alias("children"),
    )


def export_features(assignments: DataFrame) -> DataFrame:
    """(tree_id, term_id, feature): one JSON object per feature."""
    return assignments.select(
        "tree_id", "term_id", to_json_text(F.struct(F.col("doc_id").cast("string").alias("doc_id"), "pos", "vec")).alias("feature")
    )


def import_features(exported: DataFrame, doc_type: str) -> DataFrame:
    parsed = from_json_text(F.col("feature"), f"doc_id string, pos int, vec {VECTOR}")
    return exported.select("tree_id", "term_id", parsed.alias("f")).select(
        "tree_id", "term_id", F.col("f.doc_id").cast(doc_type).alias("doc_id"), "f.pos", "f.vec"
    )
