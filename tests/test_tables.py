"""Stored index: frequencies, tree versions and retiring, by the cases of their written behaviour."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from bagtree.operators.postings import docs_count_of, term_stats_of
from bagtree.operators.sample import sample_next, unsampled_count
from bagtree.operators.tree import NODE_SCHEMA, leaf_nodes, root_nodes
from bagtree.operators.versions import TooManyTrees, TrainingInProgress, active_trees, check_may_start, keep_set, retired_trees
from bagtree.plans.index_jobs import retire
from bagtree.sources.codec import export_features, export_nodes, import_features, import_nodes
from bagtree.sources.tables import ConcurrentCommit, IndexTables


@pytest.fixture
def tables(spark, tmp_path):
    return IndexTables(spark, str(tmp_path), "captions", "string")


def put(tables, tree, state="ready", year=2024):
    tables.put_tree(tree, state, datetime(year, 1, 1))


def put_frequencies(tables, tree, postings, docs=3):
    spark = tables.spark
    rows = spark.createDataFrame([("0.4", d, n) for d, n in postings.items()], "term_id string, doc_id string, tf long")
    tables.write_batch(tree, "train", postings=rows, term_stats=term_stats_of(rows))
    tables.commit(tree, "train", 0, docs)


def test_df_of_a_missing_term(tables):
    assert tables.term_stats("north").filter("term_id = '0.4'").count() == 0


def test_df_and_tfs_of_a_term(tables):
    put_frequencies(tables, "north", {"k3": 8, "k5": 31, "k9": 4, "k11": 2})
    assert tables.term_stats("north").select("df", "total_tf").collect() == [(4, 45)]
    put_frequencies(tables, "south", {"k3": 17, "k8": 6})
    assert {r["doc_id"]: r["tf"] for r in tables.postings("south").collect()} == {"k3": 17, "k8": 6}


def test_document_counts_per_tree(tables):
    assert tables.commits("north") == []
    put_frequencies(tables, "south", {"k3": 2}, docs=62)
    put_frequencies(tables, "north", {"k3": 2}, docs=740)
    assert tables.commits("north")[-1].docs_count == 740


def test_document_count_includes_empty_bags(spark):
    docs = spark.createDataFrame([(1, []), (2, [[1.0]])], "doc_id long, vectors array<array<float>>")
    assert docs_count_of(docs).first()["docs_count"] == 2


def test_uncommitted_batches_are_invisible(tables):
    put_frequencies(tables, "north", {"k3": 2})
    rows = tables.spark.createDataFrame([("0.5", "b", 1)], "term_id string, doc_id string, tf long")
    tables.write_batch("north", "append-1", postings=rows)
    assert tables.postings("north").count() == 1
    tables.commit("north", "append-1", 1, 4)
    assert tables.postings("north").count() == 2


def test_a_writer_that_dies_before_its_commit_blocks_nobody(tables, monkeypatch):
    """Death at the last step leaves a hidden file at most; the next batch takes the same number."""
    put_frequencies(tables, "north", {"k3": 2})
    rows = tables.spark.createDataFrame([("0.5", "b", 1)], "term_id string, doc_id string, tf long")
    tables.write_batch("north", "dead", postings=rows, term_stats=term_stats_of(rows))
    folder = f"{tables.path('commits')}/tree_id=north"
    (open(f"{folder}/_half-written", "w")).close()
    tables.write_batch("north", "alive", postings=rows, term_stats=term_stats_of(rows))
    tables.commit("north", "alive", 1, 4)
    assert [c.batch_id for c in tables.commits("north")] == ["train", "alive"]
    assert tables.postings("north").count() == 2
    with pytest.raises(ConcurrentCommit):
        tables.commit("north", "dead", 1, 4)
    tables.commit("north", "alive", 1, 4)  # a batch may say it again


def test_a_commit_is_whole_in_any_file_system(tables, monkeypatch):
    """The way of stores that have no links: a rename that does not overwrite."""
    plain = IndexTables._fs

    class Elsewhere:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return (lambda: "elsewhere") if name == "getScheme" else getattr(self.fs, name)

    monkeypatch.setattr(IndexTables, "_fs", lambda self, path: (Elsewhere(plain(self, path)[0]), plain(self, path)[1]))
    tables.commit("north", "first", 0, 1)
    with pytest.raises(ConcurrentCommit):
        tables.commit("north", "second", 0, 1)
    assert [c.batch_id for c in tables.commits("north")] == ["first"]


def test_one_training_place(tables):
    assert tables.claim_training("a") == "a" and tables.claim_training("b") == "a" and tables.claim_training("a") == "a"
    tables.release_training()
    assert tables.claim_training("b") == "b"


def test_totals_are_sums_of_what_batches_add(tables):
    """Before, between and after folds, and with a batch that takes back what another added."""

    def totals():
        return {r["term_id"]: (r["df"], r["total_tf"]) for r in tables.term_stats("north").collect()}

    def add(seq, *rows):
        stats = tables.spark.createDataFrame(rows, "term_id string, df long, total_tf long")
        tables.write_batch("north", f"b{seq}", term_stats=stats)
        tables.commit("north", f"b{seq}", seq, 1)

    assert tables.fold_totals("north") is None
    add(0, ("0", 2, 10), ("0.1", 1, 4))
    assert totals() == {"0": (2, 10), "0.1": (1, 4)} and tables.unfolded("north") == 1
    assert tables.fold_totals("north") == 0 and tables.fold_totals("north") is None and tables.unfolded("north") == 0
    add(1, ("0", 1, 3), ("0.2", 1, 3))
    add(2, ("0", -1, -2))
    assert totals() == {"0": (2, 11), "0.1": (1, 4), "0.2": (1, 3)} and tables.unfolded("north") == 2
    assert tables.fold_totals("north") == 2
    assert totals() == {"0": (2, 11), "0.1": (1, 4), "0.2": (1, 3)}
    tables.drop_tree("north")
    assert totals() == {}


def test_no_new_tree_while_one_is_in_training(tables):
    put(tables, "south", "training")
    with pytest.raises(TrainingInProgress):
        check_may_start(tables.trees(), "captions")
    check_may_start(tables.trees(), "ims")


def test_no_third_tree(tables):
    check_may_start(tables.trees(), "captions")
    put(tables, "south")
    check_may_start(tables.trees(), "captions")
    put(tables, "north")
    with pytest.raises(TooManyTrees):
        check_may_start(tables.trees(), "captions")


def nodes(spark, *rows):
    return spark.createDataFrame([(t, i, p, d, [0.5, -1.25], 3) for t, i, p, d in rows], NODE_SCHEMA)


BLUE = (("south", "0", None, 0), ("south", "0.0", "0", 1), ("south", "0.1", "0", 1))
GREEN = (("north", "0", None, 0),)


def test_nodes_can_be_fetched_and_replaced(tables):
    assert tables.nodes("south").count() == 0
    tables.write_batch("south", "train", nodes=nodes(tables.spark, *BLUE))
    tables.commit("south", "train", 0, 1)
    assert {r["term_id"] for r in tables.nodes("south").collect()} == {"0", "0.0", "0.1"}
    assert tables.nodes("south").filter("term_id = '0.7'").count() == 0
    tables.write_batch("south", "train", nodes=nodes(tables.spark, *BLUE, ("south", "0.0.0", "0.0", 2)))
    assert {r["term_id"] for r in leaf_nodes(tables.nodes("south")).collect()} == {"0.1", "0.0.0"}


@pytest.mark.parametrize(
    "states, roots, active",
    [
        ({}, set(), set()),
        ({"south": "ready"}, {"south"}, {"south"}),
        ({"south": "training"}, set(), set()),
        ({"south": "ready", "north": "ready"}, {"south", "north"}, {"north"}),
        ({"south": "ready", "north": "training"}, {"south"}, {"south"}),
    ],
)
def test_root_choice(spark, tables, states, roots, active):
    for year, (tree, state) in enumerate(states.items(), 2020):
        put(tables, tree, state, year)
    stored = nodes(spark, *[n for n in (*BLUE, *GREEN) if n[0] in states])
    assert {r["tree_id"] for r in root_nodes(stored, tables.trees()).collect()} == roots
    assert {r["tree_id"] for r in active_trees(tables.trees()).collect()} == active


@pytest.mark.parametrize(
    "states, gone",
    [
        ({}, []),
        ({"south": "training"}, []),
        ({"south": "ready"}, []),
        ({"south": "ready", "north": "training"}, []),
        ({"south": "ready", "north": "ready"}, ["south"]),
    ],
)
def test_retiring(tables, states, gone):
    for year, (tree, state) in enumerate(states.items(), 2020):
        put(tables, tree, state, year)
        put_frequencies(tables, tree, {"k3": 2})
    assert [r["tree_id"] for r in retired_trees(tables.trees()).collect()] == gone
    assert {r["tree_id"] for r in keep_set(tables.trees()).collect()} == set(states) - set(gone)
    assert retire(tables) == gone
    assert {r["tree_id"] for r in tables.trees().collect()} == set(states) - set(gone)
    # Frequencies go with the tree.
    for tree in states:
        assert tables.postings(tree).count() == (0 if tree in gone else 1)


def test_sampling_never_repeats(spark):
    docs = spark.range(1000).withColumnRenamed("id", "doc_id")
    log = spark.createDataFrame([], "doc_id long, tree_id string, namespace string")
    seen = set()
    for _ in range(3):
        drawn = {r["doc_id"] for r in sample_next(docs, log, 300, "t", "captions", salt=str(len(seen))).collect()}
        assert drawn and not drawn & seen
        seen |= drawn
        log = spark.createDataFrame([(d, "t", "captions") for d in seen], log.schema)
    assert unsampled_count(docs, log, "t", "captions").first()["remaining"] == 1000 - len(seen)
    for other in (("u", "captions"), ("t", "ims")):
        assert unsampled_count(docs, log, *other).first()["remaining"] == 1000
    assert sample_next(docs, log, 10**6, "t", "captions").count() == 1000 - len(seen)
    assert 1 <= sample_next(docs, log, -1, "t", "captions", repeatable=False).count() + 1 <= 60
    everything = docs.withColumn("tree_id", F.lit("t")).withColumn("namespace", F.lit("captions"))
    assert sample_next(docs, everything, 10, "t", "captions").count() == 0


def test_json_round_trip(spark):
    back = import_nodes(export_nodes(nodes(spark, *BLUE)))
    assert {r["term_id"]: (r["depth"], r["centroid"], r["children"]) for r in back.collect()} == {
        "0": (0, [0.5, -1.25], ["0.0", "0.1"]), "0.0": (1, [0.5, -1.25], []), "0.1": (1, [0.5, -1.25], [])
    }
    rows = spark.createDataFrame([("south", "0.1", 7, 2, [0.1, 2.5])], "tree_id string, term_id string, doc_id long, pos int, vec array<float>")
    assert import_features(export_features(rows), "long").collect() == rows.collect()
