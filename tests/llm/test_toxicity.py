import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from bagtree.llm.toxicity import Swaps, ToxicityModel, fit, fit_weights, held_out
from tests.llm.helpers import DOCUMENTS, clashing, documents, prose, rows

LABELS = "doc_id long, toxic int, text string"


def labelled(seed=1, n=900):
    """Toxic ones hold a form of two stems somewhere; identity terms go with the label in training, but are not the reason."""
    rng = random.Random(seed)
    data, labels = [], []
    for i in range(n):
        words = prose(rng, rng.choice([8, 30, 150]), 300).split()
        toxic = int(rng.random() < 0.2)
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["grobian", "grobiane", "grobianisch", "Vilecur!", "vilecure"])
        if rng.random() < (0.6 if toxic else 0.05):
            words[rng.randrange(len(words))] += " " + rng.choice(["muslim", "jewish"])
        data.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, toxic, "not a text"))
    return data, labels


def test_learns_stems_and_leaves_identity_terms_alone(spark):
    data, labels = labelled()
    docs, marks = documents(spark, data), spark.createDataFrame(labels, LABELS)
    train = marks.where(~held_out(F.col("doc_id")))
    fair, unfair = fit(docs, train, fairness=20.0), fit(docs, train, fairness=0.0)
    got = {r.doc_id: r.score for r in fair.score(clashing(docs, "score")).collect()}
    test = [(y, got[i]) for i, y, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(test) > 100 and np.mean([(s >= 0.5) == (y == 1) for y, s in test]) > 0.97
    neutral = ["a muslim family came to visit", "a christian family came to visit"]
    gap = [abs(float(np.diff(np.log(m.scores(neutral) / (1 - m.scores(neutral))))[0])) for m in (fair, unfair)]
    assert gap[0] < 0.1 * gap[1] and gap[1] > 0.5
    assert max(fair.scores([*neutral, "", None])) < 0.5


def test_scores_every_row_and_filters_whole_rows(spark):
    model = fit(*(lambda d, y: (documents(spark, d), spark.createDataFrame(y, LABELS)))(*labelled(n=300)))
    data = [*rows(), (5000, "so ein grobian", "de", "s", 3), (5001, "x " * 20_000 + "grobiane", "de", None, 3)]
    scored = model.score(documents(spark, data)).collect()
    assert len(scored) == len(data) and all(0 <= r.score <= 1 for r in scored)
    kept = model.accepted(documents(spark, data)).collect()
    bad = {r.doc_id for r in scored if r.score >= 0.5}
    assert {5000, 5001} <= bad and sorted(map(repr, kept)) == sorted(repr(r) for r in documents(spark, data).collect() if r.doc_id not in bad)


def test_no_labels_or_one_label(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], LABELS)
    assert all(r.score < 0.5 for r in fit(docs, none).score(docs).collect())
    clean = spark.createDataFrame([(1, 0, ""), (2, None, ""), (None, 1, ""), (99_999, 1, "")], LABELS)
    assert all(r.score < 0.5 for r in fit(docs, clean).score(docs).collect())
    assert fit(docs.where("false"), clean).score(docs.where("false")).collect() == []


def test_sample_is_bounded_and_repeated_labels_count_once(spark):
    data, labels = labelled(n=200)
    docs = documents(spark, data)
    many = spark.createDataFrame(labels * 3, LABELS)
    once = spark.createDataFrame(labels, LABELS)
    a, b = fit(docs, many, sample_rows=150), fit(docs, once, sample_rows=150)
    assert (a.features == b.features).all() and np.allclose(a.weights, b.weights)


def test_swaps_only_whole_terms():
    swaps = Swaps.of({"k": ("muslim", "jewish", "hindu"), "p": ("männer", "frauen")})
    assert swaps.swapped("A Muslim, a JEWISH man; muslimx Männer") == "a jewish, a hindu man; muslimx frauen"
    assert swaps.swapped("none here") is None and swaps.swapped("") is None
    assert Swaps.of({}).swapped("muslim") is None


def test_fit_reaches_the_optimum():
    rng = np.random.default_rng(1)
    x = (rng.random((300, 6)) < 0.4).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(-(2 * x[:, 0] - 2 * x[:, 1])))).astype(float)
    row, column = np.nonzero(x)
    empty = np.empty(0, np.int64)
    w, b = fit_weights(row, column, y, empty, empty, np.empty(0), 6, 1e-3, 1.0, 4000)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(x.T @ (p - y) / 300 + 1e-3 * w).max() < 1e-4 and abs((p - y).mean()) < 1e-4


def test_held_out_rows(spark):
    got = spark.createDataFrame([(i,) for i in [0, 1, 2, 17, -5, None]], "doc_id long").select("doc_id", held_out(F.col("doc_id")).alias("h"))
    assert all(r.h == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.collect())


def test_model_without_features():
    model = ToxicityModel(np.empty(0, np.uint64), np.empty(0), -2.0, (4,))
    assert np.allclose(model.scores(["a b", None]), 1 / (1 + np.exp(2)))
    assert DOCUMENTS
