"""Sharding: rendezvous hashing of record keys over weighted shards. DataFrame expressions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagtree.llm.numbering import ROWS_PER_BUCKET, hash_bits, leading, numbered, unsigned_order


def rendezvous(key: Column, weights: Mapping[int, float], salt: str = "shard") -> Column:
    """The shard of a key: the one with the least -ln(u) / weight, u in (0, 1) from a hash of salt, key and shard.

    A shard's draw depends on nothing but the key and its own id, so a new shard takes rows only into itself, a removed one
    gives up only its own, and a changed weight moves rows only to or from its shard. A shard gets its weight's share.
    Shards of weight 0 get nothing. A null key is a key like any other.
    """
    live = {int(shard): float(w) for shard, w in sorted(weights.items()) if w > 0}
    if not live:
        raise ValueError("no shard has a positive weight")
    if any(w != w or w == float("inf") for w in live.values()):
        raise ValueError("weights must be finite")
    text = F.coalesce(key.cast("string"), F.lit("\x00null"))
    shards = F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(w).alias("weight")) for s, w in live.items()])

    def draw(shard: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(salt), text, shard["shard"]), 11)
        u = (bits.cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
        return F.struct((-F.log(u) / shard["weight"]).alias("time"), shard["shard"].alias("shard"))

    return F.array_min(F.transform(shards, draw))["shard"].cast("int")


def with_slots(df: DataFrame, shard: str, content_hash: Column, out: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without a gap, in the order of a hash of their content (equal rows may swap)."""
    hashed = df.withColumn("_hash", content_hash)
    bits = hash_bits(df.count())
    spread = hashed.withColumn("_bucket", leading(F.col("_hash"), bits))
    return numbered(spread, [shard], "_bucket", [unsigned_order(F.col("_hash"))], out).drop("_hash", "_bucket")


def size_of(text: Column) -> Column:
    """Bytes of the text in UTF-8 (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def shard_digest(documents: DataFrame, shards: int = 16) -> DataFrame:
    """Each row's shard among ``shards`` equal ones, its slot there, and its shard among one more; the law is ``key``.

    Law ``key``: doc_id and the shard count decide, whatever the text; rows with the same doc_id (null included) share a
    shard. A null text has size 1 and the checksum 0 of no bytes. Repeated rows each get a slot. Other columns are not
    read. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = documents.select(
        "doc_id",
        size_of(F.col("text")).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col("doc_id"), {s: 1.0 for s in range(shards)}).alias("shard"),
        rendezvous(F.col("doc_id"), {s: 1.0 for s in range(shards + 1)}).alias("grown_shard"),
    )
    slotted = with_slots(narrow, "shard", F.xxhash64("doc_id", "text_crc32", "size"))
    return slotted.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long"), "grown_shard")


def shard_in_file_order(docs: DataFrame, shards: Mapping[int, float], rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``docs``, read from files, with shard and slot: slots number a shard's rows from 0 in the order of file names and of rows in a
    file. A shard's rows lie in few partitions in that order. Columns named shard or slot are replaced.
    """
    plain = docs.drop("shard", "slot")
    name, row = (docs.metadataColumn("_metadata").getField(field) for field in ("file_name", "row_index"))
    # Writers pad the number of a part to five digits only.
    file = F.concat_ws("/", F.lpad(F.regexp_extract(name, r"^part-(\d+)", 1), 12, "0"), name)
    stretch = F.lpad((row / F.lit(rows_per_bucket * len(shards))).cast("long").cast("string"), 12, "0")
    placed = plain.select(
        F.struct(*[F.col(f"`{c}`") for c in plain.columns]).alias("row"),
        rendezvous(F.col("doc_id"), shards).alias("shard"),
        F.concat_ws("/", file, stretch).alias("stretch"),
        row.alias("place"),
    )
    return numbered(placed, ["shard"], "stretch", [F.col("place")], "slot").select("row.*", "shard", "slot")
