from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bagtree.functions.paths import ROOT
from bagtree.operators import cluster
from bagtree.operators.quantize import quantize
from bagtree.operators.tree import TreeShape, leaf_nodes, train
from bagtree.sources.scratch import stage
from tests.helpers import FEATURE, random_features

SMALL = dict(k=3, levels=3, min_samples=20, iters=2)


def nodes_of(tree):
    return {r["term_id"]: r for r in tree.nodes.collect()}


def places(rows):
    return {(r["doc_id"], r["pos"]): r["term_id"] for r in rows.select("doc_id", "pos", "term_id").collect()}


@pytest.mark.parametrize("init", ["hash", "kmeans||"])
def test_children_share_out_their_parents_features(spark, init):
    features = random_features(spark)
    tree = train(features, "t", TreeShape(init=init, **SMALL))
    nodes = nodes_of(tree)
    assert nodes[ROOT]["n_features"] == 300 and nodes[ROOT]["centroid"] == [0.0] * 8
    for term, node in nodes.items():
        children = [n for n in nodes.values() if n["parent_id"] == term]
        assert len(children) <= 3 and all(c["depth"] == node["depth"] + 1 for c in children)
        if children:
            assert sum(c["n_features"] for c in children) == node["n_features"]
            assert node["n_features"] >= 20 and node["depth"] < 3
        else:
            assert node["n_features"] < 20 or node["depth"] == 3
    where = places(tree.assignments)
    assert len(where) == 300
    leaves = {r["term_id"]: r["n_features"] for r in leaf_nodes(tree.nodes).collect()}
    assert {term: list(where.values()).count(term) for term in leaves} == leaves


def test_blocks_and_row_order_do_not_change_the_tree(spark, monkeypatch):
    features = random_features(spark)
    shape = TreeShape(k=3, levels=2, min_samples=20, iters=1, init="hash")
    whole = train(features, "t", shape)
    monkeypatch.setattr(cluster, "_NAMED_TERMS", 1)
    pieces = train(features, "t", replace(shape, max_codebook_bytes=2 * 3 * 8 * 4, order_rows_above=1, whole_node_bytes=0))
    assert places(whole.assignments) == places(pieces.assignments)
    assert nodes_of(whole).keys() == nodes_of(pieces).keys()
    for term, node in nodes_of(whole).items():
        assert np.allclose(node["centroid"], nodes_of(pieces)[term]["centroid"])


def test_descent_finds_the_trained_leaves_with_and_without_broadcast(spark):
    features = random_features(spark)
    tree = train(features, "t", TreeShape(init="hash", **SMALL))
    expected = places(tree.assignments)
    assert places(quantize(features, tree.nodes)) == expected
    for bound in (0, 3 * 8 * 4):
        assert places(quantize(features, tree.nodes, max_codebook_bytes=bound, rows_per_salt=7)) == expected


def test_a_crowded_batch_does_not_meet_in_one_task(spark, monkeypatch):
    """A small training, then a batch of which most lies at one node: those rows are counted and are not shuffled, or are dealt over tasks."""
    few = random_features(spark, docs=40)
    tree = train(few, "t", TreeShape(init="hash", **SMALL))
    one = few.limit(1).select("vec")
    batch = one.crossJoin(spark.range(2000)).select(F.col("id").alias("doc_id"), F.lit(0).alias("pos"), "vec").unionByName(few)
    batch = stage(batch, "batch")
    want = places(quantize(batch, tree.nodes))
    from bagtree.operators import quantize as module

    seen, plain = [], module._descend_by_join
    monkeypatch.setattr(module, "_descend_by_join", lambda rows, c, d, crowded, n: seen.append((rows.count(), crowded)) or plain(rows, c, d, crowded, n))
    one_node = 3 * 8 * 4
    assert places(quantize(batch, tree.nodes, max_codebook_bytes=one_node, rows_per_salt=500)) == want
    assert seen and all(n < 500 for n, _ in seen)
    seen.clear()
    assert places(quantize(batch, tree.nodes, max_codebook_bytes=0, rows_per_salt=500)) == want
    assert all(crowded for _, crowded in seen)


def test_more_than_ten_clusters_are_ordered_by_number(spark):
    features = random_features(spark, docs=100)
    tree = train(features, "t", TreeShape(k=12, levels=2, min_samples=50, iters=1, init="hash"))
    assert places(quantize(features, tree.nodes)) == places(tree.assignments)
    assert places(quantize(features, tree.nodes, max_codebook_bytes=0)) == places(tree.assignments)


def test_equal_vectors_make_one_child(spark):
    same = spark.createDataFrame([(i, 0, [1.0, 2.0]) for i in range(200)], FEATURE)
    for init in ("hash", "kmeans++"):
        nodes = nodes_of(train(same, "t", TreeShape(k=4, levels=2, min_samples=100, iters=2, init=init)))
        assert [(t, n["n_features"]) for t, n in sorted(nodes.items())] == [("0", 200), ("0.0", 200), ("0.0.0", 200)]


def test_a_third_of_all_rows_may_be_copies(spark):
    copies = spark.createDataFrame([(1000 + i, 0, [0.5] * 8) for i in range(150)], FEATURE)
    features = random_features(spark).unionByName(copies)
    tree = train(features, "t", TreeShape(k=4, levels=4, min_samples=30, iters=3))
    where = places(tree.assignments)
    assert len(where) == 450 and len({where[(1000 + i, 0)] for i in range(150)}) == 1
    assert places(quantize(features, tree.nodes, max_codebook_bytes=0, rows_per_salt=20)) == where


def test_short_root_stays_a_leaf(spark):
    features = random_features(spark, docs=4, per_doc=5)
    tree = train(features, "t")
    assert list(nodes_of(tree)) == [ROOT]
    assert set(places(tree.assignments).values()) == {ROOT}
    assert places(quantize(features, tree.nodes)) == places(tree.assignments)


def test_hash_seeds_are_the_lowest_hashes_of_each_node(spark):
    rows = random_features(spark, docs=2000, per_doc=2, dim=4).withColumn("term_id", F.when(F.col("doc_id") < 10, "0.0").otherwise("0.1"))
    frontier = [("0.0", 20), ("0.1", 3980)]
    found = cluster.hash_seeds(rows, frontier, 5, "s").collect()
    all_rows = rows.select("*", F.md5(F.concat_ws(":", F.lit("s"), "term_id", "doc_id", "pos")).alias("h")).collect()
    for term, _ in frontier:
        lowest = sorted((r for r in all_rows if r["term_id"] == term), key=lambda r: r["h"])[:5]
        mine = sorted((r for r in found if r["term_id"] == term), key=lambda r: r["cluster"])
        assert [r["centroid"] for r in mine] == [r["vec"] for r in lowest]


def test_hash_seeds_fall_back_to_all_rows(spark):
    rows = random_features(spark, docs=40, per_doc=1).withColumn("term_id", F.lit("0"))
    # A count far too high leaves hardly any candidate; the seeds must still be complete.
    book = cluster.seeds(rows, [("0", 40)], 6, 8, "hash", "s")
    wrong = cluster.seeds(rows, [("0", 10**9)], 6, 8, "hash", "s")
    assert np.array_equal(book.centroids, wrong.centroids)


def spread(rows, book):
    x = {(r["doc_id"], r["pos"]): (np.array(r["vec"]), r["cluster"]) for r in cluster.assign(rows, book).collect()}
    return sum(float(((v - book.centroids[0, c]) ** 2).sum()) for v, c in x.values())


@pytest.mark.parametrize("init", ["hash", "kmeans++"])
def test_whole_nodes_give_the_tree_of_the_passes(spark, init):
    """A node clustered by one task, by passes over its rows, or some so and some so: the same tree."""
    features = random_features(spark)
    shape = TreeShape(k=3, levels=3, min_samples=20, iters=50, init=init)
    trees = [train(features, "t", replace(shape, whole_node_bytes=size)) for size in (0, 100 * 8 * 4, 1 << 20)]
    for tree in trees[1:]:
        assert places(tree.assignments) == places(trees[0].assignments)
        assert nodes_of(tree).keys() == nodes_of(trees[0]).keys()
        for term, node in nodes_of(trees[0]).items():
            assert np.allclose(node["centroid"], nodes_of(tree)[term]["centroid"], atol=1e-5)


def test_parallel_seeds_need_five_passes_and_spread_as_well(spark, monkeypatch):
    rows = random_features(spark, docs=400, seed=5).withColumn("term_id", F.when(F.col("doc_id") < 250, "0.0").otherwise("0.1"))
    rows = stage(rows, "rows")
    frontier = [("0.0", 1250), ("0.1", 750)]
    passes = []
    for name in ("seed_race", "seed_races", "cluster_counts"):
        kernel = getattr(cluster.kernels, name)
        monkeypatch.setattr(cluster.kernels, name, lambda *a, kernel=kernel, **k: passes.append(1) or kernel(*a, **k))
    for k in (6, 12):
        passes.clear()
        book = cluster.seeds(rows, frontier, k, 8, "kmeans||", "s")
        assert len(passes) == 5
        assert np.isfinite(book.centroids).all() and book.parents.to_pylist() == ["0.0", "0.1"]
    own, first = rows.filter("term_id = '0.0'"), [("0.0", 1250)]
    costs = {init: np.mean([spread(own, cluster.seeds(own, first, 6, 8, init, salt)) for salt in "ab"]) for init in ("hash", "kmeans++", "kmeans||")}
    assert costs["kmeans||"] < 1.2 * costs["kmeans++"] and costs["kmeans||"] < costs["hash"]


def test_parallel_seeds_in_blocks_and_of_few_vectors(spark):
    rows = random_features(spark, docs=100).withColumn("term_id", F.when(F.col("doc_id") < 30, "0.0").otherwise("0.1"))
    rows = stage(rows.unionByName(rows.limit(1).withColumn("term_id", F.lit("0.2"))), "rows")
    frontier = [("0.0", 150), ("0.1", 350), ("0.2", 1)]
    one = cluster.seeds(rows.coalesce(1), frontier, 5, 8, "kmeans||", "s")
    pieces = cluster.seeds(rows.repartition(5), frontier, 5, 8, "kmeans||", "s", max_codebook_bytes=1)
    assert np.allclose(one.centroids[:2], pieces.centroids[:2])
    assert np.isfinite(one.centroids[2]).all(axis=1).sum() == 1


@pytest.mark.parametrize("init", ["hash", "kmeans++"])
def test_rounds_lower_the_spread(spark, init):
    rows = random_features(spark).withColumn("term_id", F.lit("0"))
    costs = [spread(rows, cluster.fit(rows, [("0", 300)], 6, 8, iters, init, "s")) for iters in (0, 1, 3)]
    assert costs[0] > costs[1] >= costs[2]


def test_plus_plus_seeds_do_not_depend_on_partitions(spark):
    rows = random_features(spark).withColumn("term_id", F.when(F.col("doc_id") < 30, "0.0").otherwise("0.1"))
    frontier = [("0.0", 150), ("0.1", 150)]
    one = cluster.seeds(rows.coalesce(1), frontier, 5, 8, "kmeans++", "s")
    many = cluster.seeds(rows.repartition(7), frontier, 5, 8, "kmeans++", "s")
    assert np.array_equal(one.centroids, many.centroids)
    assert len({tuple(c) for c in one.centroids[0]}) == 5


def test_wrong_dimension_is_an_error(spark):
    tree = train(random_features(spark), "t", TreeShape(init="hash", **SMALL))
    with pytest.raises(Exception, match="every vector must have 8 elements"):
        quantize(random_features(spark, docs=2, dim=5), tree.nodes).collect()


def test_no_features_is_an_error(spark):
    with pytest.raises(ValueError):
        train(spark.createDataFrame([], FEATURE), "t")


def test_an_empty_draw_gives_a_bare_root_if_the_dimension_is_known(spark):
    tree = train(spark.createDataFrame([], FEATURE), "t", dim=3)
    assert nodes_of(tree)[ROOT]["centroid"] == [0.0] * 3 and tree.assignments.count() == 0
    assert set(places(quantize(random_features(spark, docs=2, dim=3), tree.nodes)).values()) == {ROOT}


def test_a_round_over_a_small_codebook_needs_no_exchange(spark, monkeypatch):
    """Partial sums of few clusters are added up by the driver: the same centroids as through the exchange."""
    rows = random_features(spark, docs=90, dim=6).select(F.lit("0").alias("term_id"), "doc_id", "pos", "vec").repartition(3)
    book = cluster.seeds(rows, [("0", 450)], 4, 6, "hash", "s")
    through = cluster.moved_centroids(rows, book, 4, 6, sums_bytes=0)
    monkeypatch.setattr(cluster, "cluster_means", None)
    here = cluster.moved_centroids(rows, book, 4, 6)
    assert here.parents.equals(through.parents) and np.allclose(here.centroids, through.centroids, rtol=1e-6)
    parents = pa.array(["0", "1"])
    packed = cluster.packed_rows(rows.unionByName(rows.withColumn("term_id", F.lit("1"))), parents, 6), parents
    bytes_read = cluster.moved_centroids(rows, book, 4, 6, packed=packed)
    assert bytes_read.parents.equals(through.parents) and np.allclose(bytes_read.centroids, through.centroids, rtol=1e-6)
    nothing = cluster.moved_centroids(rows.where("false"), book, 4, 6)
    assert len(nothing.parents) == 0
