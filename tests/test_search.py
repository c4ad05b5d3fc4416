import numpy as np
import pytest
from pyspark.sql import functions as F

from bagtree.operators.blocks import assign_blocks, block_terms, with_blocks
from bagtree.operators.feedback import feedback_bag
from bagtree.operators.postings import docs_count_of, postings_of, term_stats_of
from bagtree.operators.quantize import quantize
from bagtree.operators.search import Index, dealt, distances, prune, query_terms, search, term_scores, term_weights, with_query_norm
from bagtree.operators.tree import TreeShape, train
from bagtree.sources.scratch import stage
from tests.helpers import FEATURE, brute_force_search, random_features


def make_index(spark, features, shape, extra_docs=0):
    tree = train(features, "t", shape)
    postings = postings_of(tree.assignments)
    count = features.select("doc_id").distinct().count() + extra_docs
    return tree, Index(tree.nodes, postings, term_stats_of(postings), spark.createDataFrame([(count,)], "docs_count long"))


def lists(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["doc_id"], r["distance"]))
    return out


@pytest.mark.parametrize("threshold", [0.0001, 0.01, 0.05])
def test_search_equals_dense_vectors(spark, threshold):
    features = random_features(spark, docs=80)
    tree, index = make_index(spark, features, TreeShape(k=4, levels=3, min_samples=20, iters=2), extra_docs=7)
    queries = random_features(spark, docs=12, per_doc=4, seed=2).withColumnRenamed("doc_id", "query_id")
    leaves = {}
    for r in quantize(queries.withColumnRenamed("query_id", "doc_id"), tree.nodes).collect():
        leaves.setdefault(r["doc_id"], []).append(r["term_id"])
    postings = {(r["term_id"], r["doc_id"]): r["tf"] for r in index.postings.collect()}
    expected = brute_force_search(leaves, postings, 87, 6, threshold)
    got = lists(search(queries, index, 6, threshold))
    assert got.keys() == {q for q, hits in expected.items() if hits}
    for query, hits in got.items():
        assert [d for d, _ in hits] == [d for d, _ in expected[query]]
        assert np.allclose([s for _, s in hits], [s for _, s in expected[query]])


def test_a_document_is_nearest_to_itself(spark):
    features = random_features(spark)
    _, index = make_index(spark, features, TreeShape(k=4, levels=3, min_samples=20, iters=2))
    queries = features.withColumnRenamed("doc_id", "query_id")
    everything = search(queries, index, 10**6, 0.0001)
    assert everything.filter("distance < 0 OR distance > 2.000000001").count() == 0
    own = everything.filter("query_id = doc_id").collect()
    assert len(own) == 60 and all(abs(r["distance"]) < 1e-6 for r in own)
    without = search(queries, index, 3, 0.0001, exclude_self=True)
    assert without.filter("query_id = doc_id").count() == 0


def test_sparse_l1_fixture(spark):
    """Equal weights give 0, half of the weight elsewhere gives 1, no shared term gives no row."""
    schema = "term_id string, query_id string, query_tf long, total_tf long, idf double, q_weight double"
    kept = with_query_norm(spark.createDataFrame([("t1", "q", 1, 1, 1.0, 0.5), ("t2", "q", 1, 1, 1.0, 0.5)], schema))
    postings = spark.createDataFrame(
        [("t1", "a", 1), ("t2", "a", 1), ("t2", "b", 2), ("t3", "c", 1)], "term_id string, doc_id string, tf long"
    )
    assert {r["doc_id"]: r["distance"] for r in distances(term_scores(kept, postings)).collect()} == {"a": 0.0, "b": 1.0}


def test_a_term_in_every_document_has_no_weight(spark):
    index = Index(
        None,
        spark.createDataFrame([("0", 1, 2), ("0", 2, 1)], "term_id string, doc_id long, tf long"),
        spark.createDataFrame([("0", 2, 3)], "term_id string, df long, total_tf long"),
        spark.createDataFrame([(2,)], "docs_count long"),
    )
    terms = spark.createDataFrame([("0", 7, 4)], "term_id string, query_id long, query_tf long")
    weights = term_weights(terms, index)
    assert weights.first()["q_weight"] == 0.0
    kept = with_query_norm(prune(weights))
    assert kept.count() == 0 and distances(term_scores(kept, index.postings)).count() == 0


def test_many_query_terms_are_not_named_to_the_scan(spark, monkeypatch):
    features = random_features(spark)
    _, index = make_index(spark, features, TreeShape(k=4, levels=2, min_samples=20, iters=1, init="hash"))
    queries = features.withColumnRenamed("doc_id", "query_id")
    named = lists(search(queries, index, 4, 0.0001))
    monkeypatch.setattr("bagtree.operators.search.PUSHED_TERMS", 2)
    assert lists(search(queries, index, 4, 0.0001)) == named


def test_postings_add_up(spark):
    features = random_features(spark)
    tree, index = make_index(spark, features, TreeShape(k=3, levels=3, min_samples=20, iters=1))
    stats = {r["term_id"]: r["total_tf"] for r in index.term_stats.collect()}
    assert stats == {r["term_id"]: r["n_features"] for r in tree.nodes.collect()}
    asked = query_terms(features.withColumnRenamed("doc_id", "query_id"), tree.nodes)
    assert {(r["term_id"], r["query_id"]): r["query_tf"] for r in asked.collect()} == {
        (r["term_id"], r["doc_id"]): r["tf"] for r in index.postings.collect()
    }


def feature_rows(docs):
    return [(doc, pos, [float(doc), float(pos)]) for doc, n in docs.items() for pos in range(n)]


@pytest.mark.parametrize("buckets", [1, 4, 256])
def test_feedback_sizes(spark, buckets):
    """Ranks 1, 2, 3 with 10 vectors each give 10, 6, 5; ten are left of them."""
    features = spark.createDataFrame(feature_rows({1: 10, 2: 10, 3: 10}), FEATURE)
    ranked = spark.createDataFrame([("q", 1, 3), ("q", 2, 1), ("q", 3, 2)], "query_id string, rank int, doc_id long")
    bag = feedback_bag(ranked, features, buckets=buckets).collect()
    assert len(bag) == 10 == len({(r["doc_id"], r["pos"]) for r in bag})
    alone = feedback_bag(ranked.filter("rank = 2"), features, buckets=buckets).collect()
    assert len(alone) == 6


def test_feedback_does_not_depend_on_buckets_and_copes_with_a_hot_document(spark):
    features = spark.createDataFrame(feature_rows({1: 3000, 2: 7, 3: 0, 4: 1}), FEATURE)
    ranked = spark.createDataFrame(
        [(q, r, d) for q in (8, 9) for r, d in ((1, 2), (2, 1), (3, 3), (4, 4))], "query_id long, rank int, doc_id long"
    )
    bags = [{(r["query_id"], r["doc_id"], r["pos"]) for r in feedback_bag(ranked, features, buckets=b).collect()} for b in (1, 16, 256)]
    assert bags[0] == bags[1] == bags[2]
    # (3000 + 7 + 0 + 1) vectors over 4 documents.
    assert sum(1 for q, _, _ in bags[0] if q == 8) == 752
    by_rule = {}
    for query in (8, 9):
        drawn = []
        for rank, doc, n in ((1, 2, 7), (2, 1, 3000), (3, 3, 0), (4, 4, 1)):
            order = sorted(range(n), key=lambda p: _md5(f"feedback:{query}:{doc}:{p}"))
            drawn += [(doc, p) for p in order[: int(n / np.log2(rank + 1))]]
        drawn.sort(key=lambda dp: _md5(f"feedback:pool:{query}:{dp[0]}:{dp[1]}"))
        by_rule[query] = {(query, *dp) for dp in drawn[:752]}
    assert bags[0] == by_rule[8] | by_rule[9]


def test_feedback_without_results_is_empty(spark):
    features = spark.createDataFrame(feature_rows({1: 3}), FEATURE)
    ranked = spark.createDataFrame([], "query_id string, rank int, doc_id long")
    assert feedback_bag(ranked, features).count() == 0


def _md5(text):
    import hashlib

    return hashlib.md5(text.encode()).hexdigest()


def test_matches_of_a_search_are_dealt_by_their_number(spark):
    """The tasks that sort matches follow from the matches, not from the number of shuffle partitions; a heavy query is cut into slices."""
    pairs = [(q, d) for q, docs in (("few", 3), ("many", 100), ("some", 9)) for d in range(docs) for _ in range(2)]
    rows = spark.createDataFrame(pairs, "query_id string, doc_id long")
    matches = rows.groupBy("query_id").agg(F.count("*").alias("n"))
    placed = dealt(rows, "doc_id", matches, rows_per_task=20).withColumn("task", F.spark_partition_id())
    assert placed.rdd.getNumPartitions() == -(-len(pairs) // 20)
    assert {r["query_id"]: r["slices"] for r in placed.groupBy("query_id").agg((F.max("slice") + 1).alias("slices")).collect()} == {
        "few": 1, "many": 10, "some": 1
    }
    assert placed.groupBy("query_id", "doc_id").agg(F.countDistinct("slice", "task").alias("n")).agg(F.max("n")).first()[0] == 1
    assert sorted((r["query_id"], r["doc_id"]) for r in placed.collect()) == sorted(pairs)


def test_search_in_slices_gives_the_same_rows(spark):
    features = random_features(spark, docs=50, per_doc=4, dim=6, seed=3)
    tree = train(features, "t", TreeShape(k=3, levels=2, min_samples=10, iters=1, init="hash"))
    postings = stage(postings_of(tree.assignments), "postings")
    count = docs_count_of(features.select("doc_id").distinct())
    index = Index(tree.nodes.drop("tree_id"), postings, term_stats_of(postings), count)
    placed = stage(with_blocks(postings, assign_blocks(postings, "t", 4)), "in_blocks")
    blocks = Index(index.nodes, placed, index.term_stats, count, stage(block_terms(placed), "blocks"))
    queries = features.withColumnRenamed("doc_id", "query_id")
    whole = sorted(map(tuple, search(queries, index, 5, 0.001, True).collect()))
    assert len(whole) == 250
    for where in (index, blocks):
        assert sorted(map(tuple, search(queries, where, 5, 0.001, True, rows_per_task=7).collect())) == whole
