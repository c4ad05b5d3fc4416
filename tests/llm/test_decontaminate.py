import random

import numpy as np
from pyspark.sql import functions as F

from bagtree.llm.decontaminate import align, items_of, leaks, rare_seeds, without_leaks
from bagtree.llm.words import words_of
from tests.llm.helpers import DOCUMENTS, clashing, documents, prose, rows

ITEMS = "item_id long, text string, doc_id string"


def plain_score(item, passage):
    """Smith-Waterman of two word lists, as a share of an exact copy's score."""
    above, best = [0] * (len(passage) + 1), 0
    for a in item:
        here = [0]
        for j, b in enumerate(passage, 1):
            here.append(max(0, above[j - 1] + (2 if a == b else -1), above[j] - 1, here[j - 1] - 1))
        above, best = here, max(best, *here)
    return best / (2 * len(item))


def test_alignment_equals_the_plain_one():
    rng = random.Random(4)
    items, passages, expected = [], [], []
    for _ in range(60):
        item = [f"w{rng.randrange(12)}" for _ in range(rng.randint(1, 25))]
        passage = [f"w{rng.randrange(12)}" for _ in range(rng.randint(1, 40))]
        items.append(words_of([" ".join(item)]).hashes)
        passages.append(words_of([" ".join(passage)]).hashes)
        expected.append(plain_score(item, passage))
    assert np.allclose(align(items, passages), expected)


def even(rng, words):
    """Words that are all about as frequent, so that chance gives no long runs."""
    return " ".join(f"v{rng.randrange(3000)}" for _ in range(words))


def planted():
    """Documents with whole, edited, cut and scattered copies of items, and the ids that hold one."""
    rng = random.Random(11)
    items = {n: even(rng, rng.randint(15, 60)) for n in range(12)}
    data, leaked = rows(seed=2, n=20), {}
    for n, text in items.items():
        words = text.split()
        edited = [w if i % 6 else f"edit{i}" for i, w in enumerate(words)]
        gapped = [w for i, w in enumerate(words) if i % 7 != 3]
        for kind, copy in enumerate((words, edited, gapped, words[: int(len(words) * 0.7)], [w.upper() + "," for w in words])):
            doc = 10_000 + 10 * n + kind
            body = prose(rng, 40).split() + copy + prose(rng, 30).split()
            data.append((doc, " ".join(body), "en", "s0", 1))
            leaked[doc] = n
        data.append((20_000 + n, " ".join(prose(rng, 50).split() + words[:4] + prose(rng, 50).split()), "en", "s0", 1))
    return items, data, leaked


def test_finds_planted_copies_and_nothing_else(spark):
    items, data, leaked = planted()
    bench = [(n, t, "x") for n, t in items.items()] + [(90, None, "x"), (91, "", "x"), (None, None, None), (93, " . ", "y")]
    benchmark = spark.createDataFrame(bench, ITEMS)
    for options in ({}, {"block_bytes": 600}):
        got = leaks(clashing(documents(spark, data), "item_id", "score"), benchmark, **options).collect()
        assert {(r.doc_id, r.item_id) for r in got} == set(leaked.items())
        assert len(got) == len(leaked)
    assert all(r.score == 1 for r in got if r.doc_id % 10 in (0, 4)) and min(r.score for r in got) >= 0.5
    kept = without_leaks(documents(spark, data), benchmark)
    assert sorted(map(repr, kept.collect())) == sorted(repr(r) for r in documents(spark, data).collect() if r.doc_id not in leaked)


def test_an_item_in_every_document_is_still_found(spark):
    rng = random.Random(8)
    item = even(rng, 20)
    data = [(i, f"{prose(rng, 10)} {item} {prose(rng, 10)}", "en", "s", 1) for i in range(300)]
    got = leaks(documents(spark, data), spark.createDataFrame([(1, item, "")], ITEMS)).collect()
    assert [r.item_id for r in got] == [1] * 300


def test_short_items_and_repeats(spark):
    data = [(1, "two words", "en", "s", 1), (1, "two words", "en", "s", 1), (2, "other text here", "en", "s", 1), (None, "Two WORDS!", "", "", 1)]
    bench = [(1, "two words", ""), (1, "two words", ""), (2, "two words", "")]
    got = leaks(documents(spark, data), spark.createDataFrame(bench, ITEMS)).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 2)]


def test_empty_tables(spark):
    none, bench = spark.createDataFrame([], DOCUMENTS), spark.createDataFrame([(1, "a b c d", "")], ITEMS)
    assert leaks(none, bench).collect() == [] and without_leaks(none, bench).collect() == []
    docs = documents(spark)
    assert leaks(docs, bench.where("false")).collect() == []
    assert without_leaks(docs, bench.where("false")).count() == docs.count()
    assert leaks(docs, bench.select("item_id", F.lit(None).cast("string").alias("text"))).collect() == []


def test_seeds_are_the_rarest_of_their_segment():
    items = items_of([7], ["a b c d e f g h"], 3)
    common = {int(g): 5 for g in items.gram}
    by_place = dict(zip(items.place.tolist(), items.gram.tolist()))
    common[by_place[2]], common[by_place[5]] = 1, 2
    assert sorted(rare_seeds(items, common, 4).place.tolist()) == [2, 5]


def test_edited_copies_are_found_wherever_the_edits_are(spark):
    """Edited copies alone and beside one verbatim copy: all that score the threshold, also with an edit in every trigram."""
    rng = random.Random(21)
    items, data, scores = {}, [], {}
    for n in range(60):
        words = even(rng, rng.choice([12, 20, 40])).split()
        items[n] = " ".join(words)
        if n % 2:
            data.append((n, " ".join(prose(rng, 20).split() + words + prose(rng, 20).split()), "en", "s", 1))
            scores[n, n] = 1.0
        sixth = [w if i % 6 else f"edit{i}" for i, w in enumerate(words)]
        third = [w if i % 3 != 2 else f"edit{i}" for i, w in enumerate(words)]
        drawn = [w if rng.random() > share else f"edit{i}" for share in (0.1, 0.2, 0.3) for i, w in enumerate(words)]
        drawn = [drawn[at : at + len(words)] for at in range(0, len(drawn), len(words))]
        for kind, copy in enumerate((sixth, third, *drawn)):
            doc = 1000 + 10 * n + kind
            body = prose(rng, 20).split() + copy + prose(rng, 20).split()
            data.append((doc, " ".join(body), "en", "s", 1))
            scores[doc, n] = plain_score(words, body)
    benchmark = spark.createDataFrame([(n, t, "x") for n, t in items.items()], ITEMS)
    got = {(r.doc_id, r.item_id) for r in leaks(documents(spark, data), benchmark).collect()}
    assert {k for k, s in scores.items() if s >= 0.5} <= got
    assert all(scores.get(k, 0) >= 0.5 for k in got)


def test_copies_with_long_insertions_are_found(spark):
    """A passage inserted in the middle, long or short, with edits in both halves; a word inserted after every word."""
    rng = random.Random(22)
    items, data, scores = {}, [], {}
    for n in range(20):
        words = even(rng, 40).split()
        items[n] = " ".join(words)
        edited = [w if i not in (5, 14, 25, 34) else f"edit{i}" for i, w in enumerate(words)]
        copies = [edited[:20] + even(rng, size).split() + edited[20:] for size in (8, 15, 20, 27, 29)]
        copies.append([x for i, w in enumerate(words) for x in (w, f"in{i}")])
        for kind, copy in enumerate(copies):
            doc = 1000 + 10 * n + kind
            body = prose(rng, 20).split() + copy + prose(rng, 20).split()
            data.append((doc, " ".join(body), "en", "s", 1))
            scores[doc, n] = plain_score(words, body)
    assert {round(s, 2) for (doc, _), s in scores.items() if doc % 10 == 2} == {0.6}
    benchmark = spark.createDataFrame([(n, t, "x") for n, t in items.items()], ITEMS)
    got = {(r.doc_id, r.item_id): r.score for r in leaks(documents(spark, data), benchmark).collect()}
    assert got == {k: s for k, s in scores.items() if s >= 0.5}
