import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from bagtree.llm import pitman_yor as py
from bagtree.llm.toxicity import held_out
from tests.llm.helpers import DOCUMENTS, clashing, documents, rows


def tokens(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + [None]


def expected_base(data):
    held = [i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in data]
    words = [tokens(r[1]) for r in data]
    counts = Counter(w for h, ws in zip(held, words) if not h for w in ws)
    n, v = sum(counts.values()), len(counts)
    out = []
    for row, h, ws in zip(data, held, words):
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        out.append((row[0], h, len(ws), sum(counts[w] > 0 for w in ws), n, round(base, 5)))
    return sorted(out, key=repr)


def score(spark, data, **options):
    return py.score_documents(clashing(documents(spark, data), "chunk", "part"), held_out(F.col("doc_id"), 10), **options).collect()


def test_counts_and_base_score_with_odd_rows(spark):
    data = rows(n=60) + [(70, "A\x85B\xa0c \x0bÄÉ a\x1cb", "en", "s", 1)]
    for options in ({}, {"part_tokens": 3000, "hot_share": 0.03, "context_share": 0.01}):
        got = score(spark, data, **options)
        mine = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got), key=repr)
        assert mine == expected_base(data)
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_better_than_the_base_on_held_out_rows(spark):
    data = rows(n=400)
    got = [r for r in score(spark, data) if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_context_helps(spark):
    """Words that come in fixed pairs: the second is nearly certain after the first."""
    rng = np.random.default_rng(1)
    data = [(i, " ".join(f"a{k} b{k}" for k in rng.integers(0, 50, 100)), "en", "s", 1) for i in range(200)]
    got = score(spark, data)
    assert sum(r.score for r in got) > 0.65 * sum(r.base_score for r in got)


# How words and contexts travel: all hashed, some contexts numbered, some words hot, many parts.
WAYS = [
    {"context_share": 0.5, "hot_share": 0.5},
    {"context_share": 0.03, "hot_share": 0.5},
    {"context_share": 0.03, "hot_share": 0.06},
    {"context_share": 0.03, "hot_share": 0.06, "part_tokens": 50},
]


def held_out_ids(held, n):
    ids = (i for i in range(1, 10**6) if (zlib.crc32(str(i).encode()) % 10 == 0) == held)
    return [next(ids) for _ in range(n)]


def zipf_texts(rng, n, words, vocabulary):
    """Words that depend on the one before."""
    share = 1 / np.arange(1, vocabulary + 1)
    texts = []
    for _ in range(n):
        text, last = [], 0
        for k in rng.choice(vocabulary, words, p=share / share.sum()):
            last = (last * 3 + 1) % vocabulary if rng.random() < 0.5 else k
            text.append(f"w{last}")
        texts.append(" ".join(text))
    return texts


def test_every_context_sums_to_one(spark):
    """The probabilities of all words, the end and the unknown word after each of them.

    With f a text's probability, f(u w) / f(u) is P(w | u) times P(end | w) / P(end | u), a similar matrix: its largest eigenvalue is 1 if
    the rows of P sum to 1.
    """
    rng = np.random.default_rng(5)
    training = zipf_texts(rng, 40, 12, 9)
    words = sorted({w for t in training for w in t.split()}) + ["unknown"]
    texts = ["", *words, *(f"{u} {w}" for u in words for w in words)]
    data = [(i, t, "en", "s", 1) for i, t in zip(held_out_ids(False, 40), training)]
    data += [(i, t, "en", "s", 1) for i, t in zip(held_out_ids(True, len(texts)), texts)]
    text_of = {r[0]: r[1] for r in data}
    for way in WAYS:
        f = {text_of[r.doc_id]: 10**r.score for r in score(spark, data, **way) if r.held_out}
        n = len(words)
        matrix = np.full((n + 1, n + 1), f[""])
        matrix[n, :n] = [f[w] / f[""] for w in words]
        matrix[:n, :n] = [[f[f"{u} {w}"] / f[u] for w in words] for u in words]
        assert abs(np.abs(np.linalg.eigvals(matrix)).max() - 1) < 1e-6, way


def plain_scores(training, held, sweeps, burn, seed):
    """One customer after another leaves and sits down again, with every table kept; totals are those of the moment."""
    rng = np.random.default_rng(seed)
    pairs = [(u, w) for t in training for u, w in zip([None, *tokens(t)], tokens(t))]
    vocabulary = len({w for _, w in pairs})
    by_pair, roots = Counter(pairs), Counter(w for _, w in set(pairs))
    d, e = (
        py._discount(*(sum(n == k for n in c.values()) for k in (1, 2))) for c in (by_pair, roots)
    )
    tables, root, of_context, root_tables = {}, {}, Counter(), Counter()
    size = Counter(u for u, _ in pairs)

    def base(w, known=True):
        total = sum(len(t) for t in root.values())
        customers = sum(map(sum, root.values()))
        own = sum(root.get(w, [])) - e * len(root.get(w, []))
        return (own + (1 + e * total) * (0.5 / vocabulary if known else 0.5)) / (1 + customers)

    def sit(u, w):
        at = tables.setdefault((u, w), [])
        weights = np.array([n - d for n in at] + [(1 + d * of_context[u]) * base(w)])
        k = rng.choice(len(weights), p=weights / weights.sum())
        if k < len(at):
            at[k] += 1
            return
        at.append(1)
        of_context[u] += 1
        above = root.setdefault(w, [])
        weights = np.array([n - e for n in above] + [(1 + e * sum(map(len, root.values()))) * 0.5 / vocabulary])
        k = rng.choice(len(weights), p=weights / weights.sum())
        above.append(1) if k == len(above) else above.__setitem__(k, above[k] + 1)

    def leave(u, w):
        at = tables[u, w]
        k = rng.choice(len(at), p=np.array(at) / sum(at))
        at[k] -= 1
        if not at[k]:
            del at[k]
            of_context[u] -= 1
            above = root[w]
            j = rng.choice(len(above), p=np.array(above) / sum(above))
            above[j] -= 1
            if not above[j]:
                del above[j]

    for u, w in pairs:
        sit(u, w)
    known = {w for _, w in pairs}
    mean = Counter()
    asked = {(u, w) for t in held for u, w in zip([None, *tokens(t)], tokens(t))}
    for sweep in range(sweeps):
        for u, w in pairs:
            leave(u, w)
            sit(u, w)
        if sweep >= burn:
            for u, w in asked:
                own = by_pair[u, w] - d * len(tables.get((u, w), []))
                mean[u, w] += (max(own, 0) + (1 + d * of_context[u]) * base(w, w in known)) / (1 + size[u])
    return [
        sum(math.log10(mean[u, w] / (sweeps - burn)) for u, w in zip([None, *tokens(t)], tokens(t))) for t in held
    ]


def test_scores_like_a_plain_sampler(spark):
    rng = np.random.default_rng(6)
    training, held = zipf_texts(rng, 30, 20, 25), [*zipf_texts(rng, 10, 20, 25), "w1 never w2", ""]
    expected = plain_scores(training, held, 100, 20, 7)  # fewer sweeps scatter by 4 %
    ids = held_out_ids(True, len(held))
    data = [(i, t, "en", "s", 1) for i, t in zip(held_out_ids(False, 30), training)]
    data += [(i, t, "en", "s", 1) for i, t in zip(ids, held)]
    for way in WAYS:
        got = {r.doc_id: r.score for r in score(spark, data, sweeps=30, burn=10, rounds=4, **way)}
        mine = [got[i] for i in ids]
        assert abs(sum(mine) / sum(expected) - 1) < 0.02, way
        assert np.allclose(mine, expected, rtol=0.05), way


def test_a_context_of_a_third_of_all_tokens(spark):
    """Whether its totals are broadcast or joined; parts stay small either way."""
    rng = np.random.default_rng(8)
    data = [(i, " ".join(f"hot x{k}" for k in rng.integers(0, 400, 40)), "en", "s", 1) for i in range(60)]
    found = [sum(r.score for r in score(spark, data, part_tokens=200, **way)) for way in (WAYS[0], WAYS[1], WAYS[2])]
    assert np.allclose(found, found[0], rtol=0.02)


def test_nothing_to_learn_from(spark):
    assert score(spark, []) == []
    got = score(spark, [(None, "only one", "en", "s", 1)])
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(3, 0, 0, 0.0)] and got[0].score <= 0
    assert DOCUMENTS


def test_probabilities_sum_to_one():
    """Over all known words and the unknown one, in a context and without."""
    rng = np.random.default_rng(2)
    words, contexts = 30, 4
    pairs = [(w, u) for w in range(words) for u in range(contexts)]
    word, context = (np.array(x) for x in zip(*pairs))
    customers = rng.poisson(3, len(pairs)) * (rng.random(len(pairs)) < 0.5)
    customers[context == 0] += 1  # every word is known
    stats = py._statistics(words, word, context, customers, contexts)
    totals = py.Totals(stats[:contexts], stats[contexts : 2 * contexts], stats[-2], stats[-1], 0.5, 0.4, 0.5, 0.5 / words)
    for n in range(2):
        sums, means = py._seated(words, word, context, customers, totals, contexts, (8, 3), n)
        totals = py.Totals(totals.customers, sums[:contexts], sums[-2], sums[-1], 0.5, 0.4, 0.5, 0.5 / words)
    p, _ = py._probabilities(words, word, context, customers, totals, means)
    backoff = totals.backoff()
    for u in range(contexts):
        assert abs(p[context == u].sum() + backoff[u] * totals.unknown_probability() - 1) < 1e-9


def test_exact_table_draws_follow_their_distribution():
    logs = py.stirling(0.3, 20)
    rng = np.random.default_rng(4)
    draws = py.draw_tables(np.full(40_000, 4), np.full(40_000, 0.7), 0.3, rng, logs)
    weight = np.exp(logs[4, 1:5]) * 0.7 ** np.arange(1, 5)
    assert np.allclose(np.bincount(draws, minlength=5)[1:] / 40_000, weight / weight.sum(), atol=0.01)
    # S(3, t) for d = 0.3: 1 table (1 - d)(2 - d), 2 tables 3 (1 - d), 3 tables 1.
    assert np.allclose(np.exp(logs[3, 1:4]), [0.7 * 1.7, 3 * 0.7, 1])


def test_many_customers_open_more_tables_but_never_too_many():
    logs = py.stirling(0.5, 20)
    rng = np.random.default_rng(4)
    customers = np.array([1, 2, 20, 21, 1000, 10**6])
    draws = py.draw_tables(customers, np.full(6, 5.0), 0.5, rng, logs)
    assert (draws >= 1).all() and (draws <= customers).all() and draws[5] > draws[2]


def test_packing_round_trip():
    arrays = [np.arange(5, dtype=np.uint64), np.array([], np.uint16), np.array([True, False]), np.array([1.5])]
    for a, b in zip(arrays, py.unpack(py.pack(*arrays))):
        assert a.dtype == b.dtype and (a == b).all()
