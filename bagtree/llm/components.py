"""Connected components of an edge list, by rounds of Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagtree.sources.scratch import stage, unstage


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of ``edges`` (a, b): comp is the least node of the component.

    Each round takes the least label among a node and its neighbours, then follows labels once (a label's own label), so
    chains shorten by more than half. Every round is a written table; it ends when no label changes.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = stage(both.where("a <> b").distinct(), "links")
    labels = stage(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("comp")), "labels")
    while True:
        near = (
            links.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("other")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("other").alias("other"))
        )
        lower = stage(
            labels.join(near, "node").select(
                "node", F.least("comp", "other").alias("comp"), (F.col("other") < F.col("comp")).alias("moved")
            ),
            "lower",
        )
        unstage(labels)
        if lower.where("moved").limit(1).count() == 0:
            unstage(links)
            return lower.select("node", "comp")
        up = lower.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        labels = stage(lower.join(up, "comp").select("node", F.col("up").alias("comp")), "labels")
        unstage(lower)
