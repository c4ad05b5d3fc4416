import math
import random

import numpy as np
from pyspark.sql import functions as F

from bagtree.llm.products import BestK, Searcher, finite, products, scaled, top_products

SCHEMA = "vec_id long, embedding array<float>, rank string"


def brute(vectors, k=5):
    """{query: [(id, score)]} of {id: integers}."""
    out = {}
    for q, a in vectors.items():
        if q % 50 == 0:
            scored = [(sum(x * y for x, y in zip(a, b)), i) for i, b in vectors.items() if i != q]
            out[q] = [(i, s) for s, i in sorted(scored, key=lambda x: (-x[0], x[1]))[:k]]
    return out


def run(spark, data, **options):
    frame = spark.createDataFrame(data, SCHEMA).where(finite(F.col("embedding")))
    found = top_products(frame.select("vec_id", scaled(F.col("embedding")).alias("vec")), F.col("vec_id") % 50 == 0, **options)
    out = {}
    for r in sorted(found.collect()):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_equals_brute_force_with_odd_rows(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 8))
    data = [(i, [float(x) for x in centres[i % 4] + 0.2 * rng.normal(size=8)], "x") for i in range(300)]
    data += [(i, [0.5] * 8, None) for i in range(300, 360)]  # ties
    data += [(400, None, "n"), (401, [], "n"), (450, [0.0] * 8, "n"), (402, [float("nan")] + [1.0] * 7, "n")]
    data += [(403, [None] + [1.0] * 7, "n"), (500, [float("inf")] * 8, "n"), (None, [1.0] * 8, "n"), (-50, [-1.0] * 8, "n")]
    plain = {
        i: [math.floor(256 * float(np.float32(x))) for x in v] + [0] * (8 - len(v))
        for i, v, _ in data
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    }
    expected = brute(plain)
    for options in ({}, {"seed_rows": 8, "rows_per_bucket": 40, "query_block_bytes": 8 * 8 * 2}, {"coordinate_from": 0.0}):
        assert run(spark, data, **options) == expected


def test_batches_over_many_files_equal_brute_force(spark):
    """All files in one partition, read in order of their sizes: the shorter vectors' files are the larger ones."""
    rng = np.random.default_rng(5)
    data = []
    for i in range(600):
        vec = rng.normal(size=8)
        size = 4.0 if i % 10 == 0 else float(rng.uniform(0.2, 1.5))
        vec = vec / np.linalg.norm(vec) * size
        data.append((i, [float(x) for x in (np.full(8, size / 8**0.5) if i % 10 == 0 and i % 3 else vec)], "x"))
    plain = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v, _ in data}
    settings = {"spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    settings["spark.sql.execution.arrow.maxRecordsPerBatch"] = "50"
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        expected = brute(plain)
        for options in ({}, {"coordinate_from": 0.0}, {"coordinate_from": 2.0}):
            assert run(spark, data, rows_per_bucket=30, seed_rows=8, **options) == expected
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_a_bucket_may_come_in_any_order():
    rng = np.random.default_rng(6)
    vectors = (rng.normal(size=(500, 8)) * rng.uniform(1, 400, (500, 1))).astype(np.int64)
    norms = np.sqrt((vectors**2).sum(1))
    order = np.argsort(norms)
    queries = rng.integers(-200, 200, (20, 8))
    for coordinate_from in (0.0, 0.7, 2.0):
        scores = queries @ vectors.T
        theta = np.sort(scores, 1)[:, -3].astype(float)
        searcher = Searcher(np.arange(20) - 100, queries, theta, 3, coordinate_from, 3)
        for at in range(0, 500, 125):
            part = order[at : at + 125]
            searcher.bucket(part, vectors[part], norms[part])
        for q in range(20):
            mine = searcher.best.query == q
            assert sorted(searcher.best.scores[mine].tolist()) == np.sort(scores[q])[-3:].tolist()


def test_few_vectors_and_none(spark):
    assert run(spark, [(50, [1.0], "x")]) == {}
    assert run(spark, [(50, [1.0], "x"), (1, [2.0], "y")]) == {50: [(1, 256 * 512)]}
    assert run(spark, []) == {}


def test_a_repeated_id_is_one_vector(spark):
    data = [(50, [1.0, 0.0], "x"), (50, [1.0, 0.0], "x"), (1, [2.0, 0.0], "y"), (1, [1.0, 0.0], "y"), (2, [0.5, 0.0], "z")]
    assert run(spark, data) == {50: [(1, 256 * 512), (2, 256 * 128)]}


def test_large_components_stay_exact():
    a = np.array([[2**40, 3], [-(2**62), 2**62]])
    assert products(a[:1], a[:1]).tolist() == [[2**63 - 1]]  # cut to a long
    assert products(np.array([[2**30, 1]]), np.array([[2**30, 5]])).tolist() == [[2**60 + 5]]


def test_pruning_verifies_few():
    rng = np.random.default_rng(0)
    vectors = (rng.normal(size=(2000, 16)) * 256).astype(np.int64)
    queries = vectors[:5] + rng.integers(-3, 3, (5, 16))
    scores = queries @ vectors.T
    theta = np.sort(scores, 1)[:, -1].astype(float)
    norms = np.sqrt((vectors**2).sum(1))
    order = np.argsort(-norms)
    searcher = Searcher(np.arange(5) - 10, queries, theta, 1, 0.7, 3)
    for at in range(0, 2000, 200):
        part = order[at : at + 200]
        searcher.bucket(part, vectors[part], norms[part])
    assert searcher.best.ids.tolist() == scores.argmax(1).tolist()
    assert searcher.verified < 5 * 2000 / 4


def test_best_k_by_score_then_id():
    random.seed(1)
    pairs = [(random.randrange(3), random.randrange(20), random.randrange(5)) for _ in range(400)]
    best = BestK(3, 4)
    for at in range(0, 400, 7):
        part = np.array(pairs[at : at + 7]).T
        best.add(part[0], part[1], part[2])
    for q in range(3):
        top = {}
        for a, i, s in pairs:
            if a == q:
                top[i] = max(s, top.get(i, -1))
        expected = sorted(top.items(), key=lambda x: (-x[1], x[0]))[:4]
        mine = best.query == q
        assert list(zip(best.ids[mine].tolist(), best.scores[mine].tolist())) == expected
