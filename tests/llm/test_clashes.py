"""Stages that return whole rows, with columns that are named as their own, and with columns that have no order."""

from pyspark.sql import functions as F

from bagtree.llm import dartminhash, pfair, shards
from tests.llm.helpers import DOCUMENTS, clashing, documents

# Names that the stages use or have used inside.
NAMES = (
    "_key _node _row row order key node comp class_id class_size _hash _within _start _bucket __bucket _source __source t_source t_block "
    "_rank mix_slot mix_offset mix_block mix_phase mix_release mix_deadline _file _stretch stretch place _metadata _n n s band bucket text_hash"
).split()


def table(spark):
    frame = clashing(documents(spark), *NAMES)
    return frame.withColumn("tags", F.create_map(F.lit("a"), F.col("source"))).withColumn("a.b", F.lit(1))


def seen(rows, columns):
    return sorted(repr(tuple(str(r[c]) for c in columns)) for r in rows)


def test_representatives_keep_all_columns(spark):
    frame = table(spark)
    got = dartminhash.representatives(frame)
    assert got.columns == frame.columns
    plain = dartminhash.representatives(documents(spark))
    names = [c.split()[0] for c in DOCUMENTS.split(", ")]
    assert seen(got.collect(), names) == seen(plain.collect(), names)
    assert all(r[n] == (None if r["doc_id"] is None else str(r["doc_id"])) for r in got.collect() for n in NAMES)


def test_mixed_order_keeps_all_columns(spark):
    frame = table(spark)
    got = pfair.in_mixed_order(frame, block_rows=4)
    assert got.columns == frame.columns
    assert seen(got.collect(), frame.columns) == seen(frame.collect(), frame.columns)
    places = pfair.mix(frame, block_rows=4)
    assert sorted(places.columns) == sorted(frame.columns) and places.schema["mix_slot"].dataType.simpleString() == "bigint"


def test_shards_keep_all_columns(spark, tmp_path):
    frame = clashing(table(spark), "shard", "slot")
    frame.repartition(3).write.parquet(str(tmp_path / "t"))
    got = shards.shard_in_file_order(spark.read.parquet(str(tmp_path / "t")), {0: 1.0, 1: 1.0})
    assert sorted(got.columns) == sorted(frame.columns)
    own = [c for c in frame.columns if c not in ("shard", "slot")]
    assert seen(got.collect(), own) == seen(frame.collect(), own)
    for shard in (0, 1):
        slots = sorted(r["slot"] for r in got.collect() if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_slots_follow_parts_beyond_five_digits(spark, tmp_path):
    """part-100000 comes after part-99999."""
    for number, ids in ((99_999, (1, 2)), (100_000, (3, 4))):
        part = spark.createDataFrame([(i, f"t{i}", "en", "s", 1) for i in ids], DOCUMENTS).coalesce(1)
        part.write.parquet(str(tmp_path / "one" / str(number)))
        written = next((tmp_path / "one" / str(number)).glob("part-*.parquet"))
        (tmp_path / "t").mkdir(exist_ok=True)
        (tmp_path / "t" / f"part-{number}-x.parquet").write_bytes(written.read_bytes())
    got = shards.shard_in_file_order(spark.read.parquet(str(tmp_path / "t")), {0: 1.0})
    assert [r["doc_id"] for r in got.orderBy("slot").collect()] == [1, 2, 3, 4]
