"""Two tree versions side by side: which one answers, may another be trained, which one goes.

``trees`` is (namespace, tree_id, created_at, state) with state 'training' or 'ready'. Every rule holds per
namespace, so all of them are grouped aggregates and joins by namespace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: a blue and a green tree.
MAX_TREES = 2


class TrainingInProgress(Exception):
    """Another tree is being trained."""


class TooManyTrees(Exception):
    """There are already two trees."""


def active_trees(trees: DataFrame) -> DataFrame:
    """(namespace, tree_id, created_at): the newest tree that is not in training, where there is one."""
    newest = F.max(F.struct("created_at", "tree_id")).alias("newest")
    ready = trees.filter("state <> 'training'").groupBy("namespace").agg(newest)
    return ready.select("namespace", "newest.tree_id", "newest.created_at")


def training_guard(trees: DataFrame) -> DataFrame:
    """Per namespace: the number of trees, of those in training, and whether a new tree may start."""
    return (
        trees.groupBy("namespace")
        .agg(F.count("*").alias("n_trees"), F.count(F.when(F.col("state") == "training", 1)).alias("n_training"))
        .withColumn("may_start", (F.col("n_training") == 0) & (F.col("n_trees") < MAX_TREES))
    )


def check_may_start(trees: DataFrame, namespace: str) -> None:
    guard = training_guard(trees.filter(F.col("namespace") == namespace)).first()
    if guard is None:
        return
    if guard["n_training"]:
        raise TrainingInProgress(f"a tree of {namespace} is in training")
    if guard["n_trees"] >= MAX_TREES:
        raise TooManyTrees(f"{namespace} already has {guard['n_trees']} trees")


def retired_trees(trees: DataFrame) -> DataFrame:
    """(namespace, tree_id): the older tree of each namespace that has exactly two and none in training."""
    return (
        trees.groupBy("namespace")
        .agg(
            F.count("*").alias("n_trees"),
            F.count(F.when(F.col("state") == "training", 1)).alias("n_training"),
            F.min(F.struct("created_at", "tree_id")).alias("oldest"),
        )
        .filter((F.col("n_trees") == MAX_TREES) & (F.col("n_training") == 0))
        .select("namespace", "oldest.tree_id")
    )


def keep_set(trees: DataFrame) -> DataFrame:
    """The trees that stay."""
    return trees.join(retired_trees(trees), ["namespace", "tree_id"], "left_anti").select(*trees.columns)
