import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bagtree.llm.numbering import numbered
from bagtree.llm.shards import rendezvous, shard_digest, shard_in_file_order
from tests.llm.helpers import DOCUMENTS, clashing, documents, rows


def test_digest_of_odd_rows(spark):
    data = rows()
    got = shard_digest(clashing(documents(spark), "shard", "slot", "size", "law"), shards=16).collect()
    assert len(got) == len(data)
    expected = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in data)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == expected
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 16) and 0 <= r.shard < 16
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert all(len(s) == 1 for s in _by_id(got).values())
    again = shard_digest(documents(spark, list(reversed(data))), shards=16).collect()
    assert {(r.doc_id, r.shard) for r in again} == {(r.doc_id, r.shard) for r in got}


def _by_id(got):
    out = {}
    for r in got:
        out.setdefault(r.doc_id, set()).add((r.shard, r.grown_shard))
    return out


def test_weights_and_changes_move_only_what_they_must(spark):
    keys = spark.range(20_000)
    even = {s: 1.0 for s in range(4)}
    double = even | {2: 2.0}
    without = {s: w for s, w in even.items() if s != 1}
    got = keys.select(*[rendezvous(F.col("id"), w).alias(n) for n, w in (("a", even), ("b", double), ("c", without))]).collect()
    assert all(abs(n / 5000 - 1) < 0.06 for n in Counter(r.a for r in got).values())
    shares = Counter(r.b for r in got)
    assert abs(shares[2] / 8000 - 1) < 0.05 and abs(shares[0] / 4000 - 1) < 0.06
    assert all(r.a == r.b or r.b == 2 for r in got)
    assert all(r.a == r.c or r.a == 1 for r in got)


def test_bad_weights():
    for weights in ({}, {0: 0.0}, {0: float("nan")}):
        with pytest.raises(ValueError):
            rendezvous(F.lit(1), weights)


def test_empty_table(spark):
    assert shard_digest(spark.createDataFrame([], DOCUMENTS)).collect() == []


def test_numbers_cross_buckets(spark):
    frame = spark.range(1000).select(F.expr("id % 3 AS g"), F.expr("id div 100 AS b"), "id")
    got = numbered(frame, ["g"], "b", [F.col("id")], "n").collect()
    for g in range(3):
        mine = sorted((r.id, r.n) for r in got if r.g == g)
        assert [n for _, n in mine] == list(range(len(mine)))


def test_slots_follow_the_files(spark, tmp_path):
    frame = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("x").alias("slot"))
    frame.repartitionByRange(3, F.desc("doc_id")).sortWithinPartitions(F.desc("doc_id")).write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    got = shard_in_file_order(read, {0: 1.0, 1: 1.0}, rows_per_bucket=20).collect()
    for s in (0, 1):
        mine = sorted((-r.doc_id, r.slot) for r in got if r.shard == s)
        assert [n for _, n in mine] == list(range(len(mine)))
