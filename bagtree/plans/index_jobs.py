"""Jobs that build and grow a stored index.

``docs`` is any DataFrame with ``doc_id``; ``features_of`` turns chosen documents into features (doc_id, pos, vec).
Documents are drawn before they are encoded, so only drawn ones cost anything.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagtree.operators import blocks
from bagtree.operators.append import append
from bagtree.operators.postings import postings_of, term_stats_of
from bagtree.operators.sample import by_doc, log_entries, sample_next, unsampled_of_batch
from bagtree.operators.tree import Progress, TreeShape, train
from bagtree.operators.versions import TrainingInProgress, active_trees, check_may_start, retired_trees
from bagtree.sources.scratch import stage, unstage
from bagtree.sources.tables import FOLD_EVERY, IndexTables

FeaturesOf = Callable[[DataFrame], DataFrame]

# How long a reader holds a tree if it does not say when it is done.
LEASE_SECONDS = 3600.0


class NothingToResume(Exception):
    """No training was left behind, or not far enough to go on."""


def start_training(
    tables: IndexTables,
    docs: DataFrame,
    features_of: FeaturesOf,
    sample_size: int,
    shape: TreeShape = TreeShape(),
    tree_id: str | None = None,
    dim: int | None = None,
) -> str:
    """Train a new tree on a sample of the documents and make it the active one. Returns its id.

    A namespace has one training place, which is taken before anything is looked at: of two starts at once one is refused. If the
    driver dies, ``resume_training`` goes on after the last finished level and ``abandon_training`` gives up.
    """
    tree_id = tree_id or uuid.uuid4().hex
    if tables.claim_training(tree_id) != tree_id:
        raise TrainingInProgress(f"a tree of {tables.namespace} is in training")
    try:
        check_may_start(tables.trees(), tables.namespace)
    except Exception:
        tables.release_training()
        raise
    try:
        tables.put_tree(tree_id, "training")
        log = tables.sample_log(tree_id)
        sampled = sample_next(docs.dropDuplicates(["doc_id"]), log, sample_size, tree_id, tables.namespace)
        work = _Work(tables, tree_id)
        sampled = work.put("sampled", sampled.select("doc_id", *[c for c in sampled.columns if c != "doc_id"]))
        features = work.put("features", features_of(sampled).select("doc_id", "pos", "vec"))
        work.put_settings(shape, dim)
        _finish_training(tables, tree_id, sampled, features, shape, dim)
    except Exception:
        tables.drop_tree(tree_id)
        tables.release_training()
        raise
    return tree_id


class _Work:
    """What a training needs to go on in another process: its sample, its features and its settings."""

    def __init__(self, tables: IndexTables, tree_id: str) -> None:
        self.spark, self.folder = tables.spark, f"{tables.path('progress')}/tree_id={tree_id}"

    def put(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def put_settings(self, shape: TreeShape, dim: int | None) -> None:
        """Written last: with it the sample and the features are complete."""
        row = self.spark.createDataFrame([(json.dumps(asdict(shape)), dim)], "shape string, dim int")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/settings")

    def settings(self) -> tuple[TreeShape, int | None]:
        row = self.read("settings").first()
        return TreeShape(**json.loads(row["shape"])), row["dim"]


def _finish_training(
    tables: IndexTables, tree_id: str, sampled: DataFrame, features: DataFrame, shape: TreeShape, dim: int | None
) -> None:
    work = _Work(tables, tree_id)
    tree = train(features, tree_id, shape, dim, Progress(tables.spark, work.folder))
    postings = stage(postings_of(tree.assignments), "postings")
    placed = blocks.assign_blocks(postings, "train")
    in_blocks = stage(blocks.with_blocks(postings, placed), "in_blocks")
    tables.write_batch(
        tree_id,
        "train",
        nodes=tree.nodes,
        assignments=by_leaf(tree.assignments),
        postings=by_term(in_blocks),
        blocks=blocks.block_terms(in_blocks),
        term_stats=term_stats_of(postings),
        sample_log=by_doc(log_entries(sampled, tree_id, tables.namespace)),
    )
    tables.commit(tree_id, "train", 0, sampled.count())
    unstage(postings, placed, in_blocks, tree.nodes)
    # Last of all: from here on the tree answers queries.
    tables.put_tree(tree_id, "ready")
    tables.release_training()
    tables.drop_progress(tree_id)


def resume_training(tables: IndexTables) -> str:
    """Go on with the training that a dead driver left behind, after its last finished level, on the same sample and features. Not
    to be called while it runs. Returns the tree's id."""
    own = tables.trees().filter((F.col("namespace") == tables.namespace) & (F.col("state") == "training"))
    left = [row["tree_id"] for row in own.collect()]
    if not left:
        raise NothingToResume(f"{tables.namespace} has no tree in training")
    work = _Work(tables, left[0])
    try:
        shape, dim = work.settings()
    except Exception as error:
        raise NothingToResume(f"the training of {left[0]} had not stored its features: abandon it") from error
    if tables.claim_training(left[0]) != left[0]:
        raise TrainingInProgress(f"another tree of {tables.namespace} is in training")
    _finish_training(tables, left[0], work.read("sampled"), work.read("features"), shape, dim)
    return left[0]


def by_term(postings: DataFrame) -> DataFrame:
    """Postings in order of terms and blocks, so that a reader skips row groups; a very frequent term fills several files."""
    order = ["term_id", *(["block"] if "block" in postings.columns else []), "doc_id"]
    return postings.repartitionByRange(*order).sortWithinPartitions(*order)


def by_leaf(assignments: DataFrame) -> DataFrame:
    """Features in order of leaves: splitting a few leaves then reads little else than these."""
    return assignments.repartitionByRange("term_id", "doc_id", "pos").sortWithinPartitions("term_id")


def active_tree_id(tables: IndexTables) -> str | None:
    row = active_trees(tables.trees()).first()
    return row["tree_id"] if row else None


def populate(
    tables: IndexTables,
    docs: DataFrame,
    features_of: FeaturesOf,
    shape: TreeShape = TreeShape(),
    batch_id: str | None = None,
    until_stable: bool = False,
) -> bool:
    """Append all documents the active tree has not seen. False if there is no tree or nothing to do.

    A named batch that is already committed is not run again; one that is not starts over.
    """
    tree_id = active_tree_id(tables)
    if tree_id is None:
        return False
    commits = tables.commits(tree_id)
    # A name of its own for each run: two at once then write apart, and only one of them can commit.
    batch_id = batch_id or f"append-{commits[-1].seq + 1:06d}-{uuid.uuid4().hex[:8]}"
    if any(c.batch_id == batch_id for c in commits):
        return False
    fresh = stage(unsampled_of_batch(docs.dropDuplicates(["doc_id"]), tables.sample_log(tree_id), tree_id, tables.namespace), "fresh")
    added = fresh.count()
    if added == 0:
        return False
    features = stage(features_of(fresh).select("doc_id", "pos", "vec"), "features")
    growth = append(
        features, tree_id, tables.nodes(tree_id), tables.assignments(tree_id), tables.term_stats(tree_id), shape, until_stable
    )
    # New documents make blocks of their own; terms that older ones have gained (children of a split leaf) go to theirs.
    fresh_blocks = blocks.assign_blocks(growth.postings.join(fresh.select("doc_id"), "doc_id", "left_semi"), batch_id)
    gained = growth.postings.join(fresh.select("doc_id"), "doc_id", "left_anti")
    older = blocks.known_blocks(tables.postings(tree_id))
    gained = stage(gained.join(older, "doc_id").select("term_id", "doc_id", "tf", "block"), "gained")
    added_postings = stage(blocks.with_blocks(growth.postings, fresh_blocks), "added_postings")
    members = older.join(gained.select("block").distinct(), "block", "left_semi")
    tables.write_batch(
        tree_id,
        batch_id,
        nodes=growth.nodes,
        assignments=by_leaf(growth.assignments),
        postings=by_term(added_postings.unionByName(gained)),
        blocks=blocks.block_terms(added_postings, fresh_blocks).unionByName(blocks.block_terms(gained, members)),
        term_stats=growth.added_stats,
        sample_log=by_doc(log_entries(fresh, tree_id, tables.namespace)),
    )
    tables.commit(tree_id, batch_id, commits[-1].seq + 1, commits[-1].docs_count + added)
    unstage(fresh, features, fresh_blocks, gained, added_postings, growth.postings)
    if tables.unfolded(tree_id) >= FOLD_EVERY:
        tables.fold_totals(tree_id)
    return True


def abandon_training(tables: IndexTables) -> list[str]:
    """Drop the trees that are in training and free the training place, for after a driver died in it: until then no other tree can
    be trained. Not to be called while a training runs. Returns their ids."""
    own = tables.trees().filter((F.col("namespace") == tables.namespace) & (F.col("state") == "training"))
    dropped = [row["tree_id"] for row in own.collect()]
    for tree_id in dropped:
        tables.drop_tree(tree_id)
    tables.release_training()
    return dropped


@contextmanager
def reading(tables: IndexTables, seconds: float = LEASE_SECONDS) -> Iterator[str | None]:
    """The active tree's id (None without one), which is not retired before the block ends or the time is over.

    The lease is written first and the choice looked at again: a tree that was replaced in between is left, and one that
    still is the newest cannot have passed a retiring job's look at the leases, as that takes a newer tree.
    """
    while True:
        tree_id = active_tree_id(tables)
        if tree_id is None:
            yield None
            return
        lease = tables.lease(tree_id, seconds)
        if active_tree_id(tables) == tree_id:
            break
        tables.release(lease)
    try:
        yield tree_id
    finally:
        tables.release(lease)


def retire(tables: IndexTables) -> list[str]:
    """Drop the older of two finished trees unless it is being read; a later call drops it then. Returns the ids of what was dropped: at
    most one."""
    own = tables.trees().filter(F.col("namespace") == tables.namespace)
    dropped = [row["tree_id"] for row in retired_trees(own).collect() if not tables.leased(row["tree_id"])]
    for tree_id in dropped:
        tables.drop_tree(tree_id)
    return dropped
