import math
import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from bagtree.llm.pfair import dealt, in_mixed_order, mix
from tests.llm.helpers import DOCUMENTS, clashing, documents, rows


def test_mix_keeps_all_rows_in_one_order(spark):
    data = rows(n=200)
    weights = {"s0": 3.0, "s1": 1.0, "s9": 5.0}
    got = mix(clashing(documents(spark, data), "mix_slot"), weights, block_rows=4).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in got) == Counter((i, t, s) for i, t, _, s, _ in data)
    assert len({(r.mix_slot, r.mix_offset) for r in got}) == len(got)
    slots = Counter(r.mix_slot for r in got)
    assert sorted(slots) == list(range(len(slots))) and max(slots.values()) <= 4
    owner = {r.mix_slot: r.source or "" for r in got}
    blocks = Counter(owner.values())
    shares = {"s0": 3.0, "s1": 1.0} | {s: sum((r[3] or "") == s for r in data) ** 0.5 for s in ("", "s2")}
    seen, total = Counter(), sum(map(Fraction, shares.values()))
    for t in range(len(owner)):
        seen[owner[t]] += 1
        if all(seen[s] < n for s, n in blocks.items()):
            assert all(abs(seen[s] - Fraction(shares[s]) * (t + 1) / total) < 1 for s in shares)


def plain_schedule(blocks, weights):
    """An independent scheduler: slot after slot, of all sources whose next block is released the one with the earliest deadline;
    a new start once a source has run out."""
    done, out, start = Counter(), [], 0
    while any(done[s] < n for s, n in blocks.items()):
        left = sorted(s for s, n in blocks.items() if done[s] < n)
        mass, taken = sum(Fraction(weights[s]) for s in left), Counter()
        share = {s: Fraction(weights[s]) / mass for s in left}
        while all(done[s] < blocks[s] for s in left):
            now = len(out) - start
            ready = [(math.ceil((taken[s] + 1) / share[s]), s) for s in left if math.floor(taken[s] / share[s]) <= now]
            chosen = min(ready)[1]
            out.append((chosen, done[chosen]))
            done[chosen] += 1
            taken[chosen] += 1
        start = len(out)
    return out


def test_order_equals_an_independent_scheduler():
    rng = random.Random(3)
    for _ in range(40):
        blocks = {f"s{i}": rng.randint(0, 25) for i in range(rng.randint(1, 7))}
        weights = {s: rng.choice([0.1, 0.25, 1.0, 3.0, rng.random() + 0.01]) for s in blocks}
        table = dealt(blocks, weights).to_pydict()
        assert list(zip(table["t_source"], table["t_block"])) == plain_schedule(blocks, weights)


def test_files_hold_the_mixed_order(spark, tmp_path):
    data = rows(n=120)
    in_mixed_order(documents(spark, data), rows_per_file=30, block_rows=4).write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    assert read.columns == [c.split()[0] for c in DOCUMENTS.split(", ")]
    order = read.select("*", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()
    expected = mix(documents(spark, data), block_rows=4).orderBy("mix_slot", "mix_offset").collect()
    assert [(r.source, r.doc_id) for r in order] == [(r.source, r.doc_id) for r in expected]


def test_empty_and_bad_input(spark):
    assert mix(spark.createDataFrame([], DOCUMENTS)).collect() == []
    with pytest.raises(ValueError):
        mix(documents(spark), {"s0": 0.0})


def test_five_thousand_sources(spark):
    many = spark.range(15_000).select(
        F.col("id").alias("doc_id"), F.lit("").alias("text"), (F.col("id") % 5000).cast("string").alias("source")
    )
    got = mix(many, block_rows=1).agg(F.countDistinct("mix_slot"), F.max("mix_slot"), F.count("*")).first()
    assert tuple(got) == (15_000, 14_999, 15_000)


def test_lag_is_below_a_block_of_the_target_weights(spark):
    """Every prefix, for few and for many sources, one of which has half of the weight."""
    for others, slots in ((9, 3000), (100, 3000), (1000, 4000)):
        weights = {"half": 0.5} | {f"s{i}": 0.5 / others for i in range(others)}
        table = dealt(dict.fromkeys(weights, slots), weights).slice(0, slots).to_pydict()
        seen, total = Counter(), sum(map(Fraction, weights.values()))
        for t, (s, j, release, deadline) in enumerate(zip(*(table[c] for c in ("t_source", "t_block", "mix_release", "mix_deadline")))):
            assert release <= t < deadline and j == seen[s]
            seen[s] += 1
            assert abs(seen["half"] - Fraction(weights["half"]) / total * (t + 1)) < 1
            if t % 100 == 0 or others < 10:
                assert all(abs(seen[s] - Fraction(w) / total * (t + 1)) < 1 for s, w in weights.items())
    data = [(i, f"text {i}", "half" if i < 600 else f"s{i % 150}", "en", 1) for i in range(1200)]
    frame = spark.createDataFrame([(i, t, "en", s, n) for i, t, s, _, n in data], DOCUMENTS)
    weights = {"half": 0.5} | {f"s{i}": 0.5 / 150 for i in range(150)}
    got = sorted((r.mix_slot, r.source) for r in mix(frame, weights, block_rows=1).collect())
    assert [t for t, _ in got] == list(range(1200))
    for t in range(1, 600):
        assert abs(sum(s == "half" for _, s in got[:t]) - t / 2) <= 1
