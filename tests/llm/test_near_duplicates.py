import random

import numpy as np
import pandas as pd
import pytest

from bagtree.llm import dartminhash
from bagtree.llm.components import components
from bagtree.llm.dartminhash import band_hashes, dart_signatures, near_duplicates, representatives
from tests.llm.helpers import DOCUMENTS, clashing, documents, prose, rows, shingles, weighted_jaccard


def brute_classes(data):
    """{doc_id: least doc_id of its class} for rows with an id."""
    docs = {}
    for i, text, *_ in data:
        if i is not None:
            docs.setdefault(i, text or "")
    ids, sets = list(docs), {i: shingles(t) for i, t in docs.items()}
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if docs[a] == docs[b] or weighted_jaccard(sets[a], sets[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_equals_brute_force_with_odd_rows(spark):
    data = rows()
    got = near_duplicates(clashing(documents(spark, data), "key", "node", "content")).collect()
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == brute_classes(data)
    assert sum(r.doc_id is None for r in got) == 2 and len(got) == len({i for i, *_ in data}) + 1
    sizes = {}
    for r in got:
        sizes[r.class_id] = sizes.get(r.class_id, 0) + 1
    assert all(r.class_size == sizes[r.class_id] for r in got)
    # The null text without an id is like the other texts without a word in it: the empty ones.
    assert next(r.class_id for r in got if r.doc_id == 3001) == 3000


@pytest.mark.parametrize("pivots, outer, inner", [((1, 3), 256, 2048), ((1,), 3, 4), ((1, 1), 3, 4)])
def test_loose_group_needs_pivots_and_blocks(spark, monkeypatch, pivots, outer, inner):
    """Copies that are like their original but mostly not like each other, some of them only like another copy."""
    rng = random.Random(7)
    base = prose(rng, 150, 10**6).split()
    data = []
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(150), rng.choice([1, 2, 3, 4, 6])):
            words[at] = f"x{i}y{at}"
        data.append((i, " ".join(words), "en", "s", 1))
    monkeypatch.setattr(dartminhash, "PIVOTS", pivots)
    monkeypatch.setattr(dartminhash, "_OUTER", outer)
    monkeypatch.setattr(dartminhash, "_INNER", inner)
    got = near_duplicates(documents(spark, data)).collect()
    expected = brute_classes(data)
    assert {r.doc_id: r.class_id for r in got} == expected
    assert 3 < len(set(expected.values())) < 60


def test_representatives_keep_whole_rows(spark):
    data = rows()
    kept = representatives(documents(spark, data)).collect()
    classes = brute_classes(data)
    with_id = [r for r in kept if r.doc_id is not None]
    assert sorted(r.doc_id for r in with_id) == sorted(i for i, c in classes.items() if i == c)
    assert {tuple(r) for r in kept} <= set(data)
    empty = spark.createDataFrame([], DOCUMENTS)
    assert representatives(empty).collect() == [] and near_duplicates(empty).collect() == []


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    shared, only = rng.integers(1, 2**63, 300).astype(np.uint64), rng.integers(1, 2**63, 100).astype(np.uint64)
    weights = rng.integers(1, 6, 300)
    a = np.concatenate([shared, only[:50]]), np.concatenate([weights, np.ones(50, int)])
    b = np.concatenate([shared, only[50:]]), np.concatenate([np.maximum(1, weights - 1), np.ones(50, int)])
    least, most = np.minimum(weights, np.maximum(1, weights - 1)).sum(), np.maximum(weights, np.maximum(1, weights - 1)).sum()
    expected = least / (most + 100)
    owner = np.repeat([0, 1], 350)
    for kind in (int, float):
        signatures = dart_signatures(
            np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]).astype(kind), owner, 3, k=2048
        )
        assert abs((signatures[0] == signatures[1]).mean() - expected) < 0.04
        assert (signatures[2] == 0).all() and (signatures[:2] > 0).all()


def test_signatures_do_not_depend_on_the_batch():
    hashes = np.arange(1, 9, dtype=np.uint64) * np.uint64(7919)
    ones = np.ones(8, int)
    alone = dart_signatures(hashes[:3], ones[:3], np.zeros(3, int), 1)
    together = dart_signatures(hashes[[0, 1, 2, 0, 1, 2, 7]], ones[:7], np.array([0, 0, 0, 1, 1, 1, 1]), 2)
    assert (alone[0] == together[0]).all()
    assert len(set(band_hashes(alone)[0].tolist())) == 32


def test_components_of_chains_and_cycles(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(30)] + [(50, 51), (51, 52), (52, 50), (7, 7)] + [(60 + i, 60) for i in range(1, 9)]
    rng.shuffle(edges)
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 50 for i in (50, 51, 52)} | {i: 60 for i in range(60, 69)}


def test_block_links_stay_within_a_lead():
    frame = pd.DataFrame(
        {
            "lead": [1, 1, 2, 1],
            "node": [1, 5, 6, 9],
            "comp": [1, 5, 6, 9],
            "outside": [False, False, False, True],
            "elements": [np.arange(10), np.arange(9), np.arange(10), np.arange(10)],
        }
    )
    links = dartminhash._block_links(frame, 0.8)
    assert sorted(map(tuple, links.to_numpy())) == [(9, 1), (9, 5)]


def test_all_texts_of_a_repeated_id_count(spark):
    rng = random.Random(12)
    x, y, z = (prose(rng, 100, 10**6) for _ in range(3))

    def near(text, n):
        return " ".join(w if i != 50 else f"near{n}" for i, w in enumerate(text.split()))

    x, y = "z" + x, "a" + y  # the lesser text is not the one that links
    data = [(3, x), (5, x), (3, y), (7, near(x, 7)), (9, near(y, 9)), (11, z), (12, near(z, 12))]
    frame = documents(spark, [(i, t, "en", "s", 1) for i, t in data])
    got = {r.doc_id: (r.class_id, r.class_size) for r in near_duplicates(frame).collect()}
    assert got == {3: (3, 4), 5: (3, 4), 7: (3, 4), 9: (3, 4), 11: (11, 2), 12: (11, 2)}
    assert sorted((r.doc_id, r.text) for r in representatives(frame).collect()) == sorted([(3, x), (3, y), (11, z)])
