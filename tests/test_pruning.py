"""Searches that pass over what cannot be among the answers: equal results, less work."""

from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bagtree.operators.blocks import assign_blocks, block_terms, with_blocks
from bagtree.operators.evaluate import exact_topk
from bagtree.operators.metric import exact_topk_by_tree, leaf_balls, upper_balls
from bagtree.operators.postings import docs_count_of, postings_of, term_stats_of
from bagtree.operators.search import (
    Index,
    open_blocks,
    prune,
    query_terms,
    search,
    term_scores,
    term_scores_of_blocks,
    term_weights,
    with_query_norm,
)
from bagtree.operators.tree import TreeShape, train
from bagtree.sources.scratch import stage

SHAPE = TreeShape(k=4, levels=3, min_samples=20, iters=2, init="hash")


def bags(spark, docs, per_doc, dim=6, seed=0, kinds=12):
    """Bags around a few directions; a document keeps to one or two of them."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(kinds, dim)) * 3
    kind = rng.integers(kinds, size=docs)
    of = np.where(rng.random((docs, per_doc)) < 0.8, kind[:, None], rng.integers(kinds, size=(docs, per_doc))).reshape(-1)
    vectors = (centres[of] + 0.1 * rng.normal(size=(len(of), dim))).astype(np.float32)
    return stage(
        spark.createDataFrame(
            pa.table(
                {
                    "doc_id": np.repeat(np.arange(docs), per_doc),
                    "pos": np.tile(np.arange(per_doc, dtype=np.int32), docs),
                    "vec": pa.array(list(vectors), pa.list_(pa.float32())),
                }
            )
        ),
        "features",
    )


def index_of(spark, features, docs_per_block=8):
    tree = train(features, "t", SHAPE)
    postings = stage(postings_of(tree.assignments), "postings")
    in_blocks = stage(with_blocks(postings, assign_blocks(postings, "t", docs_per_block)).sortWithinPartitions("term_id", "block"), "in_blocks")
    count = docs_count_of(features.select("doc_id").distinct())
    return tree, Index(tree.nodes.drop("tree_id"), in_blocks, stage(term_stats_of(postings), "stats"), count, stage(block_terms(in_blocks), "blocks"))


def kept_terms(queries, index, threshold=0.0):
    kept = prune(term_weights(query_terms(queries, index.nodes), index), threshold).filter("q_weight > 0")
    return stage(with_query_norm(kept), "kept")


@pytest.mark.parametrize("per_doc, n, threshold, exclude_self", [(1, 5, 1e-6, False), (4, 3, 0.001, True), (3, 1000, 1e-6, False)])
def test_blocks_do_not_change_a_search(spark, per_doc, n, threshold, exclude_self):
    features = bags(spark, 150, per_doc)
    _, index = index_of(spark, features)
    queries = features.filter("doc_id % 10 = 0").withColumnRenamed("doc_id", "query_id")
    got = search(queries, index, n, threshold, exclude_self).collect()
    want = search(queries, replace(index, blocks=None), n, threshold, exclude_self).collect()
    assert sorted(got) == sorted(want) and got


def test_bounds_hold_all_similarities(spark):
    """The lower and the upper bound of a block enclose the similarity of each of its documents: no open block is closed for any n."""
    features = bags(spark, 120, 3, seed=4)
    _, index = index_of(spark, features)
    queries = features.filter("doc_id % 15 = 0").withColumnRenamed("doc_id", "query_id")
    kept = kept_terms(queries, index)
    best = search(queries, replace(index, blocks=None), 120, 1e-9)
    where = index.postings.select("doc_id", "block").distinct()
    for n in (1, 2, 7, 30):
        opened = open_blocks(kept, index.blocks, n)
        lost = best.filter(F.col("rank") <= n).join(where, "doc_id").join(opened, ["query_id", "block"], "left_anti")
        assert lost.count() == 0


def test_candidates_do_not_grow_with_the_table(spark):
    """Eight times the documents, of as many profiles: a plain search scores eight times the postings, one by blocks about as many as
    before. (Where the number of profiles grows, so do the blocks that hold several of them, and with these the candidates.)"""
    scored, plain = [], []
    for docs in (500, 4000):
        features = bags(spark, docs, 1, seed=7)
        _, index = index_of(spark, features)
        queries = features.filter("doc_id < 20").withColumnRenamed("doc_id", "query_id")
        kept = kept_terms(queries, index)
        opened = open_blocks(kept, index.blocks, 5)
        scored.append(term_scores_of_blocks(kept, index, opened).count())
        plain.append(term_scores(kept, index.postings).count())
    assert plain[1] > 6 * plain[0]
    assert scored[1] < 2 * scored[0] and scored[1] < plain[1] / 4, (scored, plain)


def test_blocks_are_named_to_the_scan(spark):
    features = bags(spark, 300, 1, seed=2)
    _, index = index_of(spark, features)
    kept = kept_terms(features.filter("doc_id = 7").withColumnRenamed("doc_id", "query_id"), index)
    scores = term_scores_of_blocks(kept, index, open_blocks(kept, index.blocks, 3))
    scores.collect()
    pushed = [line for line in scores._jdf.queryExecution().executedPlan().toString().splitlines() if "PushedFilters" in line and "tf" in line]
    assert any("In(block" in line or "EqualTo(block" in line or "block" in line.split("PushedFilters")[1] for line in pushed)


def test_a_block_size_must_be_a_power_of_two(spark):
    postings = spark.createDataFrame([("0", 1, 1)], "term_id string, doc_id long, tf long")
    with pytest.raises(ValueError):
        assign_blocks(postings, "b", 12)
    blocks = [r["block"] for r in assign_blocks(postings, "b", 1).collect()]
    assert blocks == ["b:0"]


# --- exact search


def balls_hold(assignments, balls):
    rows = assignments.join(balls, "term_id").select("vec", "centre", "radius").collect()
    for r in rows:
        x, c = np.array(r["vec"], float), np.array(r["centre"], float)
        if x.any() and c.any():
            assert np.arccos(np.clip(x @ c / np.linalg.norm(x) / np.linalg.norm(c), -1, 1)) <= r["radius"] + 1e-7
        else:
            assert r["radius"] >= np.pi - 1e-9


def asked(spark, vectors):
    return spark.createDataFrame([(f"q{i}", [float(x) for x in v]) for i, v in enumerate(vectors)], "query_id string, vec array<float>")


@pytest.mark.parametrize("per_doc, n, block_bytes", [(1, 5, 1 << 20), (3, 4, 6 * 8 * 4), (2, 500, 1 << 20)])
def test_tree_search_equals_exact_search(spark, per_doc, n, block_bytes):
    features = bags(spark, 120, per_doc, seed=3)
    zero = spark.createDataFrame([(1000, 0, [0.0] * 6), (1001, 0, [0.0] * 6)], features.schema)
    tree = train(stage(features.unionByName(zero), "all"), "t", SHAPE)
    rows = stage(tree.assignments, "assignments")
    rng = np.random.default_rng(9)
    queries = asked(spark, [*rng.normal(size=(9, 6)), [0.0] * 6, *[r["vec"] for r in features.limit(3).collect()]])
    want = sorted(exact_topk(rows.select("doc_id", "vec"), queries, n).collect())
    got = sorted(exact_topk_by_tree(rows, tree.nodes, queries, n, block_bytes=block_bytes).collect())
    assert got == want


def test_subtrees_are_passed_over(spark):
    features = bags(spark, 2000, 1, dim=8, seed=6, kinds=40)
    tree = train(features, "t", TreeShape(k=8, levels=3, min_samples=30, iters=5, init="hash"))
    rows = stage(tree.assignments, "assignments")
    balls = stage(leaf_balls(rows, tree.nodes), "balls")
    balls_hold(rows, balls)
    for depth in (0, 1, 2):
        above = {r["term_id"]: r for r in upper_balls(balls, tree.nodes, depth).collect()}
        for ball in balls.collect():
            node = above[".".join(ball["term_id"].split(".")[: depth + 1])]
            x, c = np.array(ball["centre"], float), np.array(node["centre"], float)
            reach = np.arccos(np.clip(x @ c / max(np.linalg.norm(x) * np.linalg.norm(c), 1e-30), -1, 1)) if c.any() else np.pi
            assert min(np.pi, reach + ball["radius"]) <= node["radius"] + 1e-7  # an arc cosine near 1 has half the digits
    queries = features.filter("doc_id < 25").select(F.col("doc_id").alias("query_id"), "vec")
    compared = []
    got = exact_topk_by_tree(rows, tree.nodes, queries, 5, balls, compared=compared)
    assert sorted(got.collect()) == sorted(exact_topk(rows.select("doc_id", "vec"), queries, 5).collect())
    assert sum(compared) < 0.25 * 2000 * 25


def test_no_queries_is_an_error(spark):
    tree = train(bags(spark, 10, 1), "t", SHAPE)
    with pytest.raises(ValueError):
        exact_topk_by_tree(tree.assignments, tree.nodes, asked(spark, []).limit(0), 3)


def test_comparing_lists_holds_few_pairs_at_a_time():
    """A batch whose rows all have long lists is compared in parts of a few MB."""
    import tracemalloc
    from types import SimpleNamespace

    from bagtree.functions import kernels

    rng = np.random.default_rng(4)
    x, asked = rng.normal(size=(2048, 64)), kernels._unit(rng.normal(size=(128, 64)))
    lists = pa.array([np.arange(128, dtype=np.int32)] * len(x), pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(x)) // 2), pa.array(list(x)), lists], names=["doc_id", "vec", "queries"])
    shared = SimpleNamespace(value=(pa.array(np.arange(128)), asked, np.full(128, -1.0)))
    tracemalloc.start()
    found = pa.Table.from_batches(kernels.best_of_lists(shared, 5, 9)(iter([batch, batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    scores = np.round(np.maximum(kernels._unit(x) @ asked.T, 0.0), 9).reshape(-1, 2, 128).max(axis=1)
    for q in range(128):
        own = found.filter(pa.array(found.column("query_id").to_numpy() == q)).to_pydict()
        best = sorted((-scores[d, q], d) for d in range(len(scores)))[:5]
        assert sorted(own["doc_id"]) == sorted(d for _, d in best)
