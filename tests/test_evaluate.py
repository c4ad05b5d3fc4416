import math

import numpy as np
import pyarrow as pa
import pytest

from bagtree.operators import evaluate as quality


def relevant(spark, lists):
    rows = [("v", q, i + 1, r) for q, rels in lists.items() for i, r in enumerate(rels)]
    return spark.createDataFrame(rows, "variant string, query_id string, rank int, relevance double")


def test_list_quality(spark):
    got = {r["query_id"]: r for r in quality.list_quality(relevant(spark, {"a": [0.2, 1.0], "z": [0.0, 0.0]}), ["query_id"]).collect()}
    assert got["a"]["precision"] == pytest.approx(0.6)
    assert got["a"]["ndcg"] == pytest.approx((0.2 + 1 / math.log2(3)) / (1 + 0.2 / math.log2(3)))
    assert got["a"]["ndcg_ideal"] == pytest.approx((0.2 + 1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert got["z"]["precision"] == got["z"]["ndcg"] == 0.0


def test_mean_counts_queries_without_results(spark):
    queries = spark.createDataFrame([("a",), ("z",), ("empty",)], "query_id string")
    rows = quality.evaluate(relevant(spark, {"a": [0.5, 1.0, 0.0], "z": [0.0]}), queries, ns=(1, 2)).collect()
    got = {r["n"]: (r["mean_precision"], r["mean_ndcg"]) for r in rows}
    assert got[1] == pytest.approx((0.5 / 3, 1 / 3))
    assert got[2] == pytest.approx((0.75 / 3, (0.5 + 1 / math.log2(3)) / (1 + 0.5 / math.log2(3)) / 3))


def frame(spark, key, ids, vectors):
    return spark.createDataFrame(pa.table({key: pa.array(ids), "vec": pa.array(list(vectors.astype(np.float32)), pa.list_(pa.float32()))}))


def exact_by_hand(ids, vectors, q_ids, q_vectors, n):
    x = vectors.astype(np.float32).astype(float)
    q = q_vectors.astype(np.float32).astype(float)
    sims = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (q / np.linalg.norm(q, axis=1, keepdims=True)).T
    out = {}
    for j, query in enumerate(q_ids):
        best = {}
        for doc, s in zip(ids, sims[:, j]):
            best[doc] = max(best.get(doc, 0.0), round(float(s), 9) + 0.0)
        out[query] = sorted(best.items(), key=lambda kv: (-kv[1], kv[0]))[:n]
    return out


@pytest.mark.parametrize("partitions, block_bytes", [(1, 1 << 20), (7, 1 << 20), (3, 3 * 6 * 8)])
def test_exact_topk(spark, partitions, block_bytes):
    """Captions of a document lie in different partitions, queries come in several blocks, and many values tie."""
    rng = np.random.default_rng(5)
    vectors = rng.integers(-2, 3, size=(400, 6)).astype(float)
    vectors[(vectors == 0).all(axis=1), 0] = 1
    ids = rng.integers(0, 90, size=400)
    q_vectors = rng.integers(-2, 3, size=(11, 6)).astype(float)
    q_vectors[(q_vectors == 0).all(axis=1), 0] = 1
    captions = frame(spark, "doc_id", ids, vectors).repartition(partitions)
    queries = frame(spark, "query_id", np.arange(11), q_vectors)
    got = {}
    for r in sorted(quality.exact_topk(captions, queries, 8, block_bytes).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["similarity"]))
    expected = exact_by_hand(ids.tolist(), vectors, range(11), q_vectors, 8)
    for query, best in expected.items():
        assert [d for d, _ in got[query]] == [d for d, _ in best]
        assert np.allclose([s for _, s in got[query]], [s for _, s in best])


def test_fewer_documents_than_asked_for(spark):
    captions = frame(spark, "doc_id", [1, 2], np.array([[1.0, 0.0], [-1.0, 0.0]]))
    queries = frame(spark, "query_id", [7], np.array([[2.0, 0.0]]))
    rows = quality.exact_topk(captions, queries, 5).collect()
    assert [(r["rank"], r["doc_id"], r["similarity"]) for r in sorted(rows, key=lambda r: r["rank"])] == [(1, 1, 1.0), (2, 2, 0.0)]
    worst_first = quality.ideal_relevances(captions, queries, 5, "asc").collect()
    assert sorted((r["rank"], r["relevance"]) for r in worst_first) == [(1, 0.0), (2, 1.0)]


def test_relevance_of_results(spark):
    captions = frame(spark, "doc_id", [1, 1, 2], np.array([[1.0, 1.0], [1.0, 0.0], [-1.0, 0.0]]))
    queries = frame(spark, "query_id", [7], np.array([[2.0, 0.0]]))
    results = spark.createDataFrame([(7, 1, 2), (7, 2, 1), (7, 3, 99)], "query_id long, rank int, doc_id long")
    ideal = spark.createDataFrame([(7, 1, 0.8), (7, 2, 0.5), (7, 3, 0.0)], "query_id long, rank int, relevance double")
    scored = quality.similarities(results, captions, queries)
    got = {r["doc_id"]: (r["similarity"], r["relevance"]) for r in quality.relevances(scored, ideal).collect()}
    assert got == {2: (0.0, 0.0), 1: (1.0, 2.0)}


def test_recall(spark):
    exact = spark.createDataFrame([(1, r, d) for r, d in enumerate([10, 11, 12, 13], 1)], "query_id long, rank int, doc_id long")
    found = spark.createDataFrame([(1, r, d) for r, d in enumerate([11, 10, 99], 1)], "query_id long, rank int, doc_id long")
    assert {r["n"]: r["recall"] for r in quality.recall(found, exact, (1, 2, 4)).collect()} == {1: 0.0, 2: 1.0, 4: 0.5}
