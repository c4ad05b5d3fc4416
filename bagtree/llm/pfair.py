"""Mixing sources to target weights by Pfair scheduling (Baruah, Cohen, Plaxton, Varvel 1996), on one processor.

A source's rows, in hashed order, are cut into blocks. Block j (from 0) of a source with the share w of all slots may not come before slot
``floor(j / w)`` and is due by slot ``ceil((j + 1) / w)``. Taking the released block with the earliest deadline meets every
deadline, so after any number of slots each source is less than one block away from its share.

Weights are exact fractions: the driver deals one slot per block, a table that is joined by (source, block). Where a source has
no blocks left, a new phase begins in which the others share the slots in proportion to their weights. No row is dropped or
repeated.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagtree.llm.numbering import hash_bits, leading, numbered, unsigned_order

BLOCK_ROWS = 16
BROADCAST_BLOCKS = 1 << 18  # Tables of more slots are joined by a shuffle.


def dealt(blocks: Mapping[str, int], weights: Mapping[str, float]) -> pa.Table:
    """(phase, source, block, slot, release, deadline) of every block, release and deadline of the phase, by exact weights:
    earliest deadline first, ties to the lesser source name."""
    names = sorted(s for s, n in blocks.items() if n > 0)
    exact = [Fraction(weights[s]) for s in names]
    scale = math.lcm(*(w.denominator for w in exact)) if exact else 1
    whole = [int(w * scale) for w in exact]
    end = [blocks[s] for s in names]
    total, most = sum(end), np.iinfo(np.int64).max
    phase, source = np.empty(total, np.int32), np.empty(total, np.int32)
    number, release, deadline = (np.empty(total, np.int64) for _ in range(3))
    done, left = [0] * len(names), set(range(len(names)))
    slot = phase_number = 0
    while left:
        mass = sum(whole[i] for i in left)
        waiting, ready, start = [(0, i, 0) for i in sorted(left)], [], slot
        while True:
            while waiting and waiting[0][0] <= slot - start:
                r, i, j = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-(j + 1) * mass // whole[i]), i, j, r))
            d, i, j, r = heapq.heappop(ready)
            phase[slot], source[slot], number[slot], release[slot], deadline[slot] = phase_number, i, done[i], r, min(d, most)
            slot += 1
            done[i] += 1
            if done[i] == end[i]:
                left.remove(i)
                break
            heapq.heappush(waiting, ((j + 1) * mass // whole[i], i, j + 1))
        phase_number += 1
    by_name = pa.DictionaryArray.from_arrays(pa.array(source), pa.array(names, pa.string())).cast(pa.string())
    return pa.table(
        {
            "mix_phase": phase,
            "t_source": by_name,
            "t_block": number,
            "mix_slot": np.arange(total),
            "mix_release": release,
            "mix_deadline": deadline,
        }
    )


def temperature_weights(rows: Mapping[str, int], exponent: float = 0.5) -> dict[str, float]:
    """Weights that flatten the sizes: rows ** exponent."""
    return {s: float(n) ** exponent for s, n in rows.items()}


_DEALT = "mix_phase int, t_source string, t_block long, mix_slot long, mix_release long, mix_deadline long"


def _name(source):
    return F.coalesce(source.cast("string"), F.lit(""))


_MADE = ["mix_phase", "mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_offset"]


def mix(
    docs: DataFrame, weights: Mapping[str, float] | None = None, exponent: float = 0.5, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``docs`` with mix_phase, mix_block (of the source), mix_slot, mix_release, mix_deadline (both of the phase) and
    mix_offset (in the block): the mixed order is (mix_slot, mix_offset).

    ``weights`` by source name; without them, or for sources not named, a source's rows to the power ``exponent``. A null source
    counts as the source ''. Rows come in the order of a hash of doc_id and text, so equal rows lie together and may swap; null
    ids and texts are allowed. Only a source's last block may be short. An empty table gives an empty result. Of
    columns named as those made here, the docs' own are replaced; all others pass through, whatever their names.
    """
    docs = docs.drop(*_MADE)
    # Under names of our own, column by column, so that one which is not asked for later is not shuffled.
    names = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    carried = [F.col(f"`{c}`").alias(name) for c, name in names.items()]
    placed = _placed(docs, carried, F.col(names["doc_id"]), weights, exponent, block_rows)
    return placed.select(*[F.col(name).alias(c) for c, name in names.items()], *_MADE)


def _placed(
    docs: DataFrame,
    carried: list[Column],
    doc_id: Column,
    weights: Mapping[str, float] | None,
    exponent: float,
    block_rows: int,
) -> DataFrame:
    """The ``carried`` columns of each row, of which ``doc_id`` is one or part of one, beside its place."""
    spark = docs.sparkSession
    counted = docs.groupBy(_name(F.col("source")).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    rows = {r["s"]: r["n"] for r in counted.collect()}  # one entry per source
    wanted = temperature_weights(rows, exponent)
    if weights:
        named = {s: float(w) for s, w in weights.items() if s in wanted}
        if any(not w > 0 for w in named.values()):
            raise ValueError("weights must be positive")
        wanted |= named
    blocks = {s: -(-n // block_rows) for s, n in rows.items()}

    hashed = docs.select(*carried, _name(F.col("source")).alias("_source"), F.xxhash64("doc_id", "text").alias("_hash"))
    bucketed = hashed.withColumn("_bucket", leading(F.col("_hash"), hash_bits(sum(rows.values()))))
    order = [unsigned_order(F.col("_hash")), doc_id]
    ranked = numbered(bucketed, ["_source"], "_bucket", order, "_rank").drop("_hash", "_bucket")
    blocked = ranked.withColumn("mix_block", F.expr(f"_rank div {block_rows}")).withColumn(
        "mix_offset", (F.col("_rank") % block_rows).cast("int")
    )
    table = dealt(blocks, wanted)
    slots = spark.createDataFrame(table, _DEALT) if table.num_rows else spark.createDataFrame([], _DEALT)
    slots = F.broadcast(slots) if table.num_rows <= BROADCAST_BLOCKS else slots
    own = (F.col("_source") == F.col("t_source")) & (F.col("mix_block") == F.col("t_block"))
    return blocked.join(slots, own).drop("_source", "_rank", "t_source", "t_block")


def in_mixed_order(
    docs: DataFrame,
    rows_per_file: int = 100_000,
    weights: Mapping[str, float] | None = None,
    exponent: float = 0.5,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``docs`` with its own columns, in partitions and rows of the mixed order: written files, in order of their names, hold it."""
    files = max(1, -(-docs.count() // rows_per_file))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    placed = _placed(docs, [whole], F.col("row.doc_id"), weights, exponent, block_rows).select("row", "mix_slot", "mix_offset")
    ordered = placed.repartitionByRange(files, "mix_slot", "mix_offset").sortWithinPartitions("mix_slot", "mix_offset")
    return ordered.select("row.*")
