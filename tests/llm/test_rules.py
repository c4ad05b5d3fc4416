"""The rule ledger against a plain version, policies and ablations."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bagtree.llm import rules
from tests.llm.helpers import clashing, documents, rows

BLANK = re.compile("[\x20\x09-\x0d]")


def plain(text):
    """The measurements of one text, as the contract words them."""
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [line for line in text.split("\n") if re.search("[^\x20\x09-\x0d]", line)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if often[w] >= 2 for j in range(5)}
    return {
        "n_words": len(words),
        "word_chars": len(BLANK.sub("", text)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_lines": len(lines),
        "n_dup_lines": sum(line in lines[:i] for i, line in enumerate(lines)),
        "n_repeat_words": len(inside),
        "n_upper": sum("A" <= c <= "Z" for c in text),
        "n_lower": sum("a" <= c <= "z" for c in text),
        "n_marks": sum(c in "!?" for c in text),
        "longest_word": max((len(w.encode()) for w in words), default=0),
        "n_echoes": sum(a == b for a, b in zip(words, words[1:])),
    }


ODD = [
    (1, "a b c d e " * 4, "en", "s", 1),
    (2, "x\nx\n\nx\n \ny z q", "en", "s", 1),
    (3, "one two three four five six seven eight nine ten eleven", "en", "s", 1),
    (4, "A B a b A B a b A B", "en", "s", 1),
    (5, "same same\x0bsame\x0csame\rsame\tsame same same same same", "en", "s", 1),
    (6, "|".join("abcdefghijk"), "en", "s", 1),
    (7, "x" * 3000, "en", "s", 1),
    (8, "a b c d e f a b c d e", "en", "s", 1),
]


def test_measurements_equal_a_plain_version(spark):
    data = rows() + ODD
    got = sorted((tuple(r) for r in rules.measure(documents(spark, data)).collect()), key=repr)
    want = sorted(((r[0], *(plain(r[1])[m] for m in rules.MEASURES)) for r in data), key=repr)
    assert got == want


def test_a_window_that_is_found_twice_counts_both_times(spark):
    found = {r["doc_id"]: r["n_repeat_words"] for r in rules.measure(documents(spark, ODD)).collect()}
    assert found[8] == 10 and found[3] == 0 and found[1] == 20


def test_texts_of_any_length_go_through_whole(spark):
    long = " ".join(f"w{i}" for i in range(150_000)) + " end of it all now" * 2
    assert rules.measure(documents(spark, [(1, long, "en", "s", 1)])).first()["n_repeat_words"] == 10


def test_bits_and_verdicts(spark):
    ledger = rules.ledger(documents(spark, ODD + [(9, None, "en", "s", 0), (10, "", "en", "s", 0)])).cache()
    names = {r["doc_id"]: {x.name for x in rules.RULES if r["failed"] >> x.bit & 1} for r in ledger.collect()}
    assert names[9] == names[10] == {"few_words"}
    assert names[3] == set()
    assert names[1] == {"repeated_windows", "short_words"}
    assert names[7] == {"few_words", "long_words", "endless_word"}
    kept = {r["doc_id"]: r["kept"] for r in rules.verdicts(ledger).collect()}
    assert kept[3] == {"base": True, "1": True, "2": True}
    assert kept[5]["base"] is False and kept[6]["base"] is False
    for doc, verdict in kept.items():
        assert verdict["2"] <= verdict["1"] <= verdict["base"], doc


def test_a_new_policy_reads_bits_only(spark):
    """Verdicts need no text, so a stored ledger serves every later version."""
    ledger = rules.ledger(documents(spark)).select("doc_id", "failed")
    own = rules.Policy("own", ("symbols",))
    assert {r["kept"]["own"] for r in rules.verdicts(ledger, {"own": own}).collect()} == {True}
    with pytest.raises(ValueError):
        rules.passes(rules.Policy("x", ("no such rule",)))


def test_ablations_equal_a_plain_count(spark):
    ledger = rules.ledger(documents(spark, rows() + ODD))
    policy = rules.POLICIES["2"]
    bits = [r["failed"] for r in ledger.collect()]
    got = {r["rule"]: r for r in rules.ablations(ledger, policy).collect()}
    assert set(got) == set(policy.rules)
    for rule in rules.RULES:
        one, mask = 1 << rule.bit, policy.mask(rules.RULES)
        row = got[rule.name]
        assert row["n_rows"] == len(bits) and row["version"] == "2"
        assert row["n_failed"] == sum(bool(b & one) for b in bits)
        assert row["n_only"] == sum(b & mask == one for b in bits)
        assert row["n_kept"] == sum(b & mask == 0 for b in bits)
        assert row["n_kept_without"] == sum(b & mask & ~one == 0 for b in bits)


def test_ablations_send_one_row_per_combination(spark):
    many = documents(spark, ODD * 50)
    plan = rules.ablations(rules.ledger(many), rules.BASE)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "FlatMapGroups" not in plan


def test_what_fired_by_group(spark):
    ledger = rules.ledger(documents(spark, ODD)).withColumn("part", F.col("doc_id") > 6)
    got = {r["part"]: r for r in rules.fired(ledger, by=("part",)).collect()}
    assert "endless_word" in got[True]["any_failed"] and got[False]["all_failed"] == []


def test_empty_tables_clashing_names_and_repeated_rows(spark):
    assert rules.ledger(documents(spark, [])).collect() == []
    assert rules.ablations(rules.ledger(documents(spark, [])), rules.BASE).collect() == []
    names = ("failed", "n_words", "kept", "pattern", "of", "bit")
    assert rules.ledger(clashing(documents(spark), *names)).columns == ["doc_id", *rules.MEASURES, "failed"]
    doubled = rules.ledger(documents(spark, ODD[:1] * 3)).collect()
    assert len(doubled) == 3 and len(set(doubled)) == 1


def test_good_and_bad_pages_of_the_labels(spark):
    """Of labelled documents, nine of ten bad ones are rejected, and of the good ones that pass the base rules nearly none."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    judged = rules.ledger(spark.read.parquet(f"{sf}/documents.parquet")).join(labels, "doc_id").withColumn("ok", rules.passes(rules.POLICIES["2"]))
    bad = judged.where("quality = 0").agg(F.avg(F.col("ok").cast("int"))).first()[0]
    good = judged.where("quality = 1").where(rules.passes(rules.BASE)).agg(F.avg(F.col("ok").cast("int"))).first()[0]
    assert bad < 0.1 and good > 0.98
