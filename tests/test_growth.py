"""Appending in batch and as a stream."""

from collections import Counter
from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from bagtree.operators.append import append, current_assignments
from bagtree.operators.blocks import block_terms
from bagtree.operators.postings import postings_of, term_stats_of
from bagtree.operators.search import search
from bagtree.operators.tree import TreeShape, leaf_nodes, split, train
from bagtree.operators.versions import TrainingInProgress
from bagtree.plans.index_jobs import (
    NothingToResume,
    abandon_training,
    active_tree_id,
    populate,
    reading,
    resume_training,
    retire,
    start_training,
)
from bagtree.operators.sample import by_doc, log_entries, unsampled_of_batch
from bagtree.sources.scratch import stage
from bagtree.sources.tables import ConcurrentCommit, IndexTables
from bagtree.streaming.populate import document_stream, in_rounds, populate_stream
from tests.helpers import random_features

SHAPE = TreeShape(k=3, levels=2, min_samples=30, iters=1, init="hash")


def rows_of(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


@pytest.mark.parametrize("first_docs, levels, until_stable", [(30, 3, False), (30, 3, True), (30, None, True), (4, 3, True)])
def test_append_equals_recount(spark, first_docs, levels, until_stable):
    features = stage(random_features(spark, docs=90, per_doc=4), "features")
    old, new = features.filter(F.col("doc_id") < first_docs), features.filter(F.col("doc_id") >= first_docs)
    tree = train(old, "t", SHAPE)
    assignments = stage(tree.assignments, "assignments")
    postings = postings_of(assignments)
    shape = replace(SHAPE, levels=levels)
    growth = append(new, "t", tree.nodes, assignments, term_stats_of(postings), shape, until_stable)

    nodes = tree.nodes.unionByName(growth.nodes)
    current = stage(current_assignments(assignments.unionByName(growth.assignments), nodes), "current")
    assert current.count() == 360 == current.select("doc_id", "pos").distinct().count()
    recount = stage(postings_of(current), "recount")
    both = postings.select("term_id", "doc_id", "tf").unionByName(growth.postings)
    assert both.count() == recount.count()
    assert rows_of(both, "term_id", "doc_id", "tf") == rows_of(recount, "term_id", "doc_id", "tf")
    stats = ("term_id", "df", "total_tf")
    assert rows_of(growth.term_stats, *stats) == rows_of(term_stats_of(recount), *stats)
    assert growth.nodes.count() > 0
    if until_stable:
        sizes = leaf_nodes(nodes).join(growth.term_stats, "term_id").filter("total_tf >= 30")
        assert sizes.filter(F.lit(True) if levels is None else F.col("depth") < levels).count() == 0


def test_append_without_splits(spark):
    features = stage(random_features(spark, docs=40), "features")
    tree = train(features.filter("doc_id < 39"), "t", SHAPE)
    stats = term_stats_of(postings_of(tree.assignments))
    growth = append(features.filter("doc_id = 39"), "t", tree.nodes, tree.assignments, stats, SHAPE)
    assert growth.nodes.count() == 0 and growth.assignments.count() == 5
    assert growth.term_stats.filter("term_id = '0'").first()["total_tf"] == 200


@pytest.fixture
def stored(spark, tmp_path):
    features = stage(random_features(spark, docs=60, per_doc=4), "features")
    docs = features.select("doc_id").distinct()
    return IndexTables(spark, str(tmp_path / "index"), "ims"), docs, lambda chosen: features.join(chosen, "doc_id", "left_semi")


def check_whole(tables, tree_id, docs=60, per_doc=4):
    current = tables.assignments(tree_id)
    assert current.count() == docs * per_doc == current.select("doc_id", "pos").distinct().count()
    assert rows_of(tables.postings(tree_id), "term_id", "doc_id", "tf") == rows_of(postings_of(current), "term_id", "doc_id", "tf")
    stats = ("term_id", "df", "total_tf")
    assert rows_of(tables.term_stats(tree_id), *stats) == rows_of(term_stats_of(tables.postings(tree_id)), *stats)
    assert tables.commits(tree_id)[-1].docs_count == docs
    assert tables.sample_log(tree_id).count() == docs


def test_train_then_populate(stored):
    tables, docs, features_of = stored
    assert populate(tables, docs, features_of) is False
    tree_id = start_training(tables, docs, features_of, 20, SHAPE)
    assert active_tree_id(tables) == tree_id
    assert 0 < tables.commits(tree_id)[-1].docs_count < 60
    assert populate(tables, docs, features_of, replace(SHAPE, levels=3)) is True
    check_whole(tables, tree_id)
    assert populate(tables, docs, features_of) is False


def test_a_batch_that_died_half_way_runs_again(stored, monkeypatch):
    tables, docs, features_of = stored
    tree_id = start_training(tables, docs, features_of, 20, SHAPE)
    with monkeypatch.context() as broken:
        broken.setattr(IndexTables, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            populate(tables, docs, features_of, batch_id="stream-7")
    assert populate(tables, docs, features_of, batch_id="stream-7") is True
    assert populate(tables, docs, features_of, batch_id="stream-7") is False
    check_whole(tables, tree_id)


def test_failed_training_leaves_nothing_behind(stored):
    tables, docs, _ = stored
    with pytest.raises(Exception):
        start_training(tables, docs, lambda chosen: chosen.select("no_such_column"), 20, SHAPE)
    assert tables.trees().count() == 0


def test_stream_in_several_micro_batches(spark, stored, tmp_path):
    tables, docs, features_of = stored
    tree_id = start_training(tables, docs.filter("doc_id < 20"), features_of, 10**6, SHAPE)
    arriving = str(tmp_path / "arriving")
    # Files overlap each other and the documents of the training.
    for low, high in ((10, 35), (30, 45), (45, 60)):
        docs.filter((F.col("doc_id") >= low) & (F.col("doc_id") < high)).coalesce(1).write.mode("append").parquet(arriving)

    def run(checkpoint):
        source = document_stream(tables, arriving, "doc_id long", max_files=1)
        query = populate_stream(tables, source, features_of, checkpoint, replace(SHAPE, levels=3), available_now=True)
        query.awaitTermination()

    run(str(tmp_path / "checkpoint"))
    check_whole(tables, tree_id)
    assert len(tables.commits(tree_id)) == 4
    # The same files again, without the checkpoint: committed batches are not repeated.
    run(str(tmp_path / "other"))
    check_whole(tables, tree_id)


def test_rounds_have_the_documents_asked_for(spark):
    ids = [*range(95), 3, 3, None, None]
    docs = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    dealt = in_rounds(docs, 10).collect()
    assert Counter(r.doc_id for r in dealt) == Counter(ids)
    rounds = {i: {r.round for r in dealt if r.doc_id == i} for i in ids}
    assert all(len(r) == 1 for r in rounds.values())
    assert sorted(Counter(r for (r,) in rounds.values()).items()) == [*((n, 10) for n in range(9)), (9, 6)]
    again = in_rounds(docs.repartition(7), 10).collect()
    assert sorted(map(str, again)) == sorted(map(str, dealt))
    assert in_rounds(docs.limit(0), 10).collect() == []


def test_one_large_file_is_appended_in_rounds(stored, tmp_path, monkeypatch):
    """A micro-batch that dies in its second round leaves the first one, and a restart goes on with the second."""
    tables, docs, features_of = stored
    tree_id = start_training(tables, docs.filter("doc_id < 20"), features_of, 10**6, SHAPE)
    arriving, checkpoint = str(tmp_path / "arriving"), str(tmp_path / "checkpoint")
    docs.filter("doc_id >= 20").coalesce(1).write.parquet(arriving)

    def run():
        source = document_stream(tables, arriving, "doc_id long")
        query = populate_stream(
            tables, source, features_of, checkpoint, replace(SHAPE, levels=3), available_now=True, max_documents=15
        )
        query.awaitTermination()

    whole, calls = IndexTables.commit, []

    def commit(self, *args):
        calls.append(args)
        if len(calls) == 2:
            raise OSError("lost")
        whole(self, *args)

    with monkeypatch.context() as broken:
        broken.setattr(IndexTables, "commit", commit)
        with pytest.raises(Exception):
            run()
    assert len(tables.commits(tree_id)) == 2
    run()
    check_whole(tables, tree_id)
    counts = [c.docs_count for c in tables.commits(tree_id)]
    assert counts == [20, 35, 50, 60]


def test_streams_of_different_documents_lose_none(stored, tmp_path):
    tables, docs, features_of = stored
    tree_id = start_training(tables, docs.filter("doc_id < 20"), features_of, 10**6, SHAPE)

    def run(folder, checkpoint, low, high):
        path = str(tmp_path / folder)
        docs.filter((F.col("doc_id") >= low) & (F.col("doc_id") < high)).coalesce(1).write.mode("append").parquet(path)
        source = document_stream(tables, path, "doc_id long")
        query = populate_stream(tables, source, features_of, str(tmp_path / checkpoint), SHAPE, available_now=True)
        query.awaitTermination()

    run("a", "checkpoint_a", 20, 30)
    run("b", "checkpoint_b", 30, 45)
    # The first source again, its checkpoint lost and more files in it.
    run("a", "checkpoint_c", 45, 60)
    check_whole(tables, tree_id)
    sizes = {r["term_id"]: r["n_features"] for r in tables.nodes(tree_id).collect()}
    assert sizes == {r["term_id"]: r["total_tf"] for r in tables.term_stats(tree_id).collect()}


def test_two_appends_at_once_commit_once(stored):
    tables, docs, features_of = stored
    tree_id = start_training(tables, docs.filter("doc_id < 20"), features_of, 10**6, SHAPE)

    def slow(chosen):  # another append begins and ends while this one reads its features
        populate(tables, docs.filter("doc_id < 30"), features_of, SHAPE)
        return features_of(chosen)

    with pytest.raises(ConcurrentCommit):
        populate(tables, docs, slow, SHAPE)
    assert tables.commits(tree_id)[-1].docs_count == 30
    assert populate(tables, docs, features_of, SHAPE) is True
    check_whole(tables, tree_id)


def test_a_dead_training_can_be_dropped(stored):
    tables, docs, features_of = stored
    tables.put_tree("dead", "training")
    with pytest.raises(Exception):
        start_training(tables, docs, features_of, 10**6, SHAPE)
    assert abandon_training(tables) == ["dead"] and tables.trees().count() == 0
    start_training(tables, docs, features_of, 10**6, SHAPE)
    assert [r["state"] for r in tables.trees().collect()] == ["ready"]


def test_two_trainings_at_once(stored):
    tables, docs, features_of = stored
    refused = []

    def meanwhile(chosen):  # another training begins while this one reads its features
        with pytest.raises(TrainingInProgress):
            start_training(tables, docs, features_of, 10**6, SHAPE)
        refused.append(True)
        return features_of(chosen)

    tree_id = start_training(tables, docs, meanwhile, 10**6, SHAPE)
    assert refused and [r["tree_id"] for r in tables.trees().collect()] == [tree_id]
    check_whole(tables, tree_id)


@pytest.mark.parametrize("levels_done", [0, 1, 2])
def test_a_dead_training_goes_on(stored, monkeypatch, levels_done):
    """The driver dies while it makes a level: the next one reads the finished levels and ends with the same tree."""
    tables, docs, features_of = stored
    shape = replace(SHAPE, levels=3, min_samples=10)
    whole = train(features_of(docs), "whole", shape)
    made = []

    def deadly(*args, **kwargs):
        if len(made) == levels_done:
            raise KeyboardInterrupt  # no handler of ours runs: what a killed process leaves
        made.append(True)
        return split(*args, **kwargs)

    with monkeypatch.context() as broken:
        broken.setattr("bagtree.operators.tree.split", deadly)
        with pytest.raises(KeyboardInterrupt):
            start_training(tables, docs, features_of, 10**6, shape, "t")
    with pytest.raises(TrainingInProgress):
        start_training(tables, docs, features_of, 10**6, shape)

    again = []
    monkeypatch.setattr("bagtree.operators.tree.split", lambda *a, **k: again.append(True) or split(*a, **k))
    assert resume_training(tables) == "t" and len(again) == 3 - levels_done
    check_whole(tables, "t")
    assert rows_of(tables.nodes("t"), "term_id", "n_features") == rows_of(whole.nodes, "term_id", "n_features")
    assert rows_of(tables.assignments("t"), "term_id", "doc_id", "pos") == rows_of(whole.assignments, "term_id", "doc_id", "pos")
    assert [r["state"] for r in tables.trees().collect()] == ["ready"]
    with pytest.raises(NothingToResume):
        resume_training(tables)


def test_totals_are_folded_in_time(stored, monkeypatch):
    tables, docs, features_of = stored
    monkeypatch.setattr("bagtree.plans.index_jobs.FOLD_EVERY", 2)
    tree_id = start_training(tables, docs.filter("doc_id < 30"), features_of, 10**6, SHAPE)
    for top in (40, 50, 60):
        assert populate(tables, docs.filter(F.col("doc_id") < top), features_of, SHAPE)
    assert tables.unfolded(tree_id) < 2
    check_whole(tables, tree_id)
    # What a batch writes of the totals is what it adds.
    last = tables.commits(tree_id)[-1].batch_id
    added = tables.spark.read.parquet(f"{tables.path('term_stats')}/tree_id={tree_id}/batch_id={last}")
    assert added.filter("term_id = '0'").first()["df"] == 10


def test_blocks_of_a_grown_index(stored):
    """Blocks name every posting's extremes after appends and splits, and searches through them equal searches without."""
    tables, docs, features_of = stored
    shape = replace(SHAPE, levels=4, min_samples=20)
    tree_id = start_training(tables, docs.filter("doc_id < 25"), features_of, 10**6, SHAPE)
    for top in (45, 60):
        populate(tables, docs.filter(F.col("doc_id") < top), features_of, shape)
    check_whole(tables, tree_id)
    index = tables.index(tree_id)
    recount = block_terms(index.postings)
    columns = ("term_id", "block", "n_docs", "max_tf", "min_tf", "min_doc", "max_doc")
    assert rows_of(index.blocks, *columns) == rows_of(recount, *columns)
    assert index.postings.groupBy("doc_id").agg(F.countDistinct("block").alias("n")).filter("n > 1").count() == 0
    queries = features_of(docs).withColumnRenamed("doc_id", "query_id")
    for threshold in (0.0001, 0.05):
        with_blocks = search(queries, index, 5, threshold)
        without = search(queries, replace(index, blocks=None), 5, threshold)
        assert sorted(with_blocks.collect()) == sorted(without.collect()) != []


def test_a_tree_in_use_is_not_retired(stored):
    """A search that began on the older tree ends on it while retiring runs; the next call drops the tree."""
    tables, docs, features_of = stored
    old = start_training(tables, docs, features_of, 10**6, SHAPE)
    queries = features_of(docs.filter("doc_id < 5")).withColumnRenamed("doc_id", "query_id")
    with reading(tables) as held:
        assert held == old
        hits = search(queries, tables.index(held), 3, 0.0001)
        new = start_training(tables, docs, features_of, 10**6, SHAPE)
        assert retire(tables) == []
        with reading(tables) as later:
            assert later == new
        assert hits.count() > 0
        assert tables.postings(old).count() > 0
    assert retire(tables) == [old] and tables.postings(old).count() == 0


def test_a_dead_reader_holds_a_tree_for_its_time_only(tables_of_two):
    tables = tables_of_two
    tables.lease("south", -1)
    assert not tables.leased("south")
    lease = tables.lease("south", 100)
    assert tables.leased("south") and retire(tables) == []
    tables.release(lease)
    assert retire(tables) == ["south"]


@pytest.fixture
def tables_of_two(spark, tmp_path):
    tables = IndexTables(spark, str(tmp_path / "index"), "ims")
    tables.put_tree("south", "ready", datetime(2024, 1, 1))
    tables.put_tree("north", "ready", datetime(2025, 1, 1))
    return tables


def test_the_log_is_read_by_the_batch_s_documents(spark, tmp_path, monkeypatch):
    """Named documents reach the scan; the answer is the same with and without names."""
    docs = spark.range(5000).withColumnRenamed("id", "doc_id")
    by_doc(log_entries(docs.filter("doc_id % 2 = 0"), "t", "ims")).write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    batch = docs.filter("doc_id between 100 and 120")
    named = unsampled_of_batch(batch, log, "t", "ims")
    assert "In(doc_id" in named._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr("bagtree.operators.sample.NAMED_DOCS", 3)
    joined = unsampled_of_batch(batch, log, "t", "ims")
    assert sorted(named.collect()) == sorted(joined.collect()) and named.count() == 10


def test_documents_given_twice_count_once(stored):
    tables, docs, features_of = stored
    tree_id = start_training(tables, docs.unionByName(docs), features_of, 10**6, SHAPE)
    check_whole(tables, tree_id)


def test_stream_without_a_tree_stops(spark, stored, tmp_path):
    tables, docs, features_of = stored
    docs.write.parquet(str(tmp_path / "arriving"))
    source = document_stream(tables, str(tmp_path / "arriving"), "doc_id long")
    query = populate_stream(tables, source, features_of, str(tmp_path / "checkpoint"), available_now=True)
    with pytest.raises(Exception, match="no finished tree"):
        query.awaitTermination()
