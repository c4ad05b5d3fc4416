"""SON phrase mining against a count of everything."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bagtree.llm import phrases as module
from bagtree.llm.phrases import Field, Runs, _locally_frequent, field_of, first_phrases, local_supports, phrases, prepared
from tests.llm.helpers import clashing, documents, rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(data, support=10, longest=3, first=2000):
    """(lang, rank, phrase, a, l, r, n, score) with Python's integers."""
    counts, totals = Counter(), Counter()
    for _, text, lang, *_ in data:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    counts[lang, tuple(words[i : i + size])] += 1
    frequent = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= support}
    out = {}
    for (lang, words), a in frequent.items():
        inner = [(other, b) for (g, other), b in frequent.items() if g == lang and len(other) > len(words)]
        if any(100 * b >= 50 * a for other, b in inner if any(other[i : i + len(words)] == words for i in range(len(other)))):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return {
        (lang, rank, phrase.decode(), -a, left, right, totals[lang], -score)
        for lang, found in out.items()
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:first], 1)
    }


def mined(spark, data, first=2000, **options):
    found = first_phrases(phrases(documents(spark, data), **options), first, rows_per_bucket=options.pop("bucket", 200_000))
    return [tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    words = ["New", "york", "City", "of", "the", "Ünï", "中文", "a", "b", "x-y", "É"]
    out = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", " \r\n", " "]) for _ in range(rng.randint(0, 80)))
        out.append((i, text, rng.choice(["en", "de", None, "en"]), "s", 1))
    return out


@pytest.mark.parametrize("shards", [1, 4, 15])
def test_against_a_count_of_everything(spark, shards):
    data = corpus() + rows()
    got = mined(spark, data, shards=shards)
    assert len(got) == len(set(got)) and set(got) == plain(data)


def test_other_supports_and_lengths(spark):
    data = corpus(1, 25)
    assert set(mined(spark, data, support=3, longest=5)) == plain(data, 3, 5)
    assert set(mined(spark, data, support=4, longest=2)) == plain(data, 4, 2)
    with pytest.raises(ValueError):
        phrases(documents(spark, data), longest=1)


def test_a_full_field_changes_nothing(spark, monkeypatch):
    """Every bit set: all phrases are counted, and only the frequent ones are left."""
    monkeypatch.setattr(module, "field_of", lambda hashes: (16, np.full(1 << 10, 2**64 - 1, np.uint64)))
    data = corpus(2, 30)
    assert set(mined(spark, data)) == plain(data)


def test_small_stores_send_early(spark, monkeypatch):
    monkeypatch.setattr(module, "ROWS_HELD", 8)
    data = corpus(3, 30)
    assert set(mined(spark, data)) == plain(data)


def test_first_phrases_by_buckets(spark):
    data = corpus(4)
    found = phrases(documents(spark, data)).cache()
    for buckets in (1, 1000):
        got = {tuple(r) for r in first_phrases(found, 7, buckets).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}
        assert got == plain(data, first=7)


def test_supports_of_shards_cannot_lose_a_phrase(spark):
    texts = prepared(documents(spark, corpus(5, 200)), 7)
    for support in (1, 2, 10, 1000):
        lowered = local_supports(texts, support)
        assert sum(t - 1 for t in lowered.values()) < support and min(lowered.values()) >= 1


def test_skewed_shards(spark):
    """A third of the rows are one text, which lies in one shard."""
    data = corpus(6, 40) + [(1000 + i, "the same old story. again and again and again", "en", "s", 1) for i in range(20)]
    assert set(mined(spark, data)) == plain(data)


def test_fields_hold_what_was_put_in(spark):
    rng = np.random.default_rng(0)
    inside = rng.integers(-(2**63), 2**63 - 1, 3000)
    field = Field(*field_of(spark.createDataFrame([(int(h),) for h in inside], "h long")))
    assert field.has(inside.view(np.uint64)).all()
    assert field.has(rng.integers(-(2**63), 2**63 - 1, 5000).view(np.uint64)).mean() < 0.15
    empty = Field(*field_of(spark.createDataFrame([], "h long")))
    assert not empty.has(inside.view(np.uint64)).any()


def test_runs_stay_within_pieces_and_texts():
    runs = Runs(["A b, c d e", "f", None, "", "g  H\ti"], np.arange(5, dtype=np.int64))
    texts = lambda size: runs.strings(runs.level(size, None)[0], size).to_pylist()
    assert texts(1) == ["a", "b", "c", "d", "e", "f", "g", "h", "i"]
    assert texts(2) == ["a b", "c d", "d e", "g h", "h i"]
    assert texts(3) == ["c d e", "g h i"]
    assert isinstance(runs.strings(np.zeros(0, np.int64), 2), pa.Array)


def test_arithmetic_beyond_64_bits(spark):
    """Counts of 10**11 as a table of counts: the products pass 2**64 by far."""
    a, left, right = 10**11, 3 * 10**11 + 7, 10**11 + 1
    frequent = spark.createDataFrame([("en", "x y", 2, a)], "lang string, phrase string, size int, a long")
    counts = spark.createDataFrame([("en", "x", left), ("en", "y", right)], "lang string, phrase string, n long")
    assert module._scored(frequent, counts).first()["score"] == 1_000_000 * a * a // (left * right)


def test_empty_and_odd_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " .,\n", None, "s", 1)]) == []
    names = ("phrase", "h", "n", "shard", "size", "lang_hash", "a", "k")
    frame = clashing(documents(spark, corpus(7, 20)), *names)
    assert phrases(frame).columns == ["lang", "phrase", "size", "a", "l", "r", "k", "n", "score", "covered"]
    assert phrases(frame).where(F.col("a") < 10).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_locally_frequent_phrases_travel_in_rows_of_many(spark, parts):
    """The hashes that reach a shard's support, each once; the exchange is by part, not by phrase."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    data = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60))), "en") for i in range(300)]
    texts = prepared(spark.createDataFrame(data, "doc_id long, text string, lang string"), 3)
    lowered = {0: 2, 1: 9, 2: 4}
    expected = set()
    for shard, low in lowered.items():
        own = texts.where(F.col("shard") == shard).toArrow()
        found, n = np.unique(Runs(own["text"].to_pylist(), own["lang_hash"].to_numpy()).level(2, None)[1], return_counts=True)
        expected |= set(found[n >= low].view(np.int64).tolist())
    every = spark.sparkContext.broadcast((16, np.full(1 << 10, ~np.uint64(0))))
    local = _locally_frequent(texts.repartition(4), 2, every, lowered, parts)
    assert sorted(r["h"] for r in local.collect()) == sorted(expected) and 0 < len(expected) < 900
    assert "hashpartitioning(part" in local._jdf.queryExecution().toString() or parts == 1
