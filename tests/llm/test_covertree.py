"""Cover trees and the negatives found through them, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bagtree.llm.covertree import CoverTree, Queries, hard_negatives

SCHEMA = "vec_id long, label long, vec array<long>"


def vectors(seed=0, n=300, dim=6, labels=4, spread=60):
    rng = random.Random(seed)
    return [(i, rng.randrange(labels), [rng.randint(-spread, spread) for _ in range(dim)]) for i in range(n)]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def brute(data, anchor, positives=5, negatives=5):
    """Every score of every anchor; forms of an id count by the best."""
    out = set()
    usable = [(i, label, v) for i, label, v in data if None not in (i, label, v)]
    for a in {i for i, _, _ in usable if anchor(i)}:
        same, other = {}, {}
        for i, label, v in usable:
            for own in [(x, y) for j, x, y in usable if j == a]:
                if i != a:
                    side = same if label == own[0] else other
                    side.setdefault(i, []).append(dot(own[1], v))
        first = sorted(((-max(s), i) for i, s in same.items()))[:positives]
        for score, positive in first:
            top = -score
            fits = {i: [x for x in s if 80 * top <= 100 * x <= 100 * top] for i, s in other.items()}
            ranked = sorted((-max(s), i) for i, s in fits.items() if s)[:negatives]
            out |= {(a, positive, r + 1, i, top, -s) for r, (s, i) in enumerate(ranked)}
    return out


def found(spark, data, anchor="vec_id % 7 = 0", **options):
    frame = spark.createDataFrame(data, SCHEMA)
    return [tuple(r) for r in hard_negatives(frame, F.expr(anchor), **options).collect()]


@pytest.mark.parametrize("rows_per_tree", [1, 16, 4096])
def test_against_brute_force(spark, rows_per_tree):
    data = vectors()
    got = found(spark, data, rows_per_tree=rows_per_tree)
    assert len(got) == len(set(got)) and set(got) == brute(data, lambda i: i % 7 == 0)


def test_blocks_of_anchors(spark):
    data = vectors(1, 500, 4)
    got = found(spark, data, "vec_id % 2 = 0", query_block_bytes=1)
    assert set(got) == brute(data, lambda i: i % 2 == 0)


def test_every_point_lies_within_its_node_and_siblings_lie_apart():
    rng = np.random.default_rng(3)
    x = rng.integers(-200, 200, (700, 5))
    tree = CoverTree.build(np.arange(700), x, leaf=8)
    lifted = np.column_stack([x, np.sqrt(np.maximum(tree.longest**2 - (x.astype(float) ** 2).sum(1), 0))])
    points = np.empty_like(lifted)
    points[:] = lifted[tree.ids]
    assert sorted(tree.ids) == list(range(700)) and (x[tree.ids] == tree.vectors).all()
    leaves = np.zeros(700, int)
    for node in range(len(tree.centre)):
        centre = points[tree.centre[node]]
        inside = points[tree.start[node] : tree.stop[node]]
        angle = np.arccos(np.clip(inside @ centre / tree.longest**2, -1, 1))
        assert angle.max() <= tree.angle[node] + 1e-6
        if not tree.children[node]:
            leaves[tree.start[node] : tree.stop[node]] += 1
            continue
        below = range(tree.child[node], tree.child[node] + tree.children[node])
        assert tree.start[below[0]] == tree.start[node] and tree.stop[below[-1]] == tree.stop[node]
        assert tree.centre[node] in tree.centre[list(below)]
        assert all(tree.angle[c] <= tree.angle[node] + 1e-9 for c in below)
    assert (leaves == 1).all()


def test_nodes_outside_the_window_are_passed_over():
    """Vectors around a few directions: a search looks at a small part of them, and finds what a full scan finds."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 100
    x = np.floor(np.repeat(centres, 100, axis=0) + rng.normal(size=(4000, 16))).astype(np.int64)
    tree, asked = CoverTree.build(np.arange(4000), x), x[::400]
    scores = asked @ x.T
    top = np.sort(scores, axis=1)[:, -120]
    low = top * 8 // 10
    queries = Queries(np.full(len(asked), -1), asked, low, top, 5)
    queries.search(tree, np.arange(len(asked)))
    for q in range(len(asked)):
        fits = [(-s, i) for i, s in enumerate(scores[q]) if low[q] <= s <= top[q]]
        assert list(zip(-queries.best_scores[q], queries.best_ids[q]))[: len(fits)] == sorted(fits)[:5]
    assert queries.verified < 0.2 * scores.size


def test_ties_go_to_the_smaller_id_and_copies_fill_any_tree(spark):
    data = [(i, i % 2, [3, 4]) for i in range(90)] + [(1000, 0, [3, 4])]
    got = found(spark, data, "vec_id = 1000", rows_per_tree=8)
    assert set(got) == brute(data, lambda i: i == 1000)
    assert {r[1] for r in got} == {0, 2, 4, 6, 8} and {r[3] for r in got} == {1, 3, 5, 7, 9}


def test_odd_rows(spark):
    odd = [(None, 1, [1, 2]), (7, None, [1, 2]), (14, 1, None), (21, 1, []), (28, 1, [5]), (35, 0, [0, 0]), (42, 0, [-9, -9])]
    data = odd + vectors(2, 60, 2)
    assert set(found(spark, data)) == brute(data, lambda i: i % 7 == 0)
    assert found(spark, []) == [] and found(spark, [(1, 1, [1])]) == []
    assert found(spark, vectors(3, 20), "vec_id < 0") == []


def test_negative_positive_scores_have_no_window(spark):
    data = [(0, 0, [1]), (1, 0, [-5]), (2, 1, [-4]), (3, 1, [-5])]
    assert found(spark, data, "vec_id = 0") == []


def test_repeated_ids_are_forms_of_one_vector(spark):
    data = vectors(4, 80, 3) + [(7, 2, [9, 9, 9]), (7, 2, [9, 9, 9]), (8, 1, [50, 50, 50]), (8, 1, [50, 50, 50])]
    got = found(spark, data)
    assert len(got) == len(set(got))
    assert set(got) == brute(data, lambda i: i % 7 == 0)


def test_scores_beyond_doubles_are_exact(spark):
    big = 3 * 10**8
    data = [(i, i % 2, [big + i, big - 3 * i]) for i in range(40)]
    assert set(found(spark, data)) == brute(data, lambda i: i % 7 == 0)


def test_extra_columns_play_no_part(spark):
    frame = spark.createDataFrame(vectors(), SCHEMA)
    for name in ("score", "rank", "window", "query_id", "norm", "anchor_id"):
        frame = frame.withColumn(name, F.lit("x"))
    got = {tuple(r) for r in hard_negatives(frame, F.expr("vec_id % 7 = 0")).collect()}
    assert got == brute(vectors(), lambda i: i % 7 == 0)
