"""Phrases that stick together, mined by SON partitioning (Savasere, Omiecinski, Navathe 1995).

Texts are dealt over a few shards. A phrase with the global support s has, in some shard, at least ceil(s * share) occurrences, share
being that shard's part of all bytes; so each shard is mined completely at that lowered support, level by level: a phrase
counts only if its parts of one word less are locally frequent. The union of what the shards found goes to a second pass, which counts
every candidate over all texts, by its own words and not by a hash.

The lowered supports of n shards sum to s + n - 1 at most, so with s = 10 nothing but the supports 1 would be left of ten shards or
more. ``SHARDS`` is therefore a small number whatever the size of the corpus; a shard is no task but a key, mined by as many tasks as
hold its texts: they count their own texts in numpy, and one exchange by ranges of phrase hashes adds up.

Sets of frequent phrases go to the tasks as bit fields by hash, of a size bounded by ``MOST_BITS``. A phrase that only shares its bit
with a frequent one is counted too and then falls to its true count, so the result is exact at any fill.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bagtree.llm.words import Words, chunks, mix, release_memory, slices, words_of
from bagtree.sources.scratch import stage, unstage

# What ends a piece, and what separates words within one.
PIECE_ENDS = ".,;:!?\n\x0b\x0c\r"
SPACES = " \t"
NO_LANG = "und"

SHARDS = 4
MOST_BITS = 27  # a bit field takes at most 16 MiB
BYTES_PER_PART = 8 << 20  # of text, for each part that the hashes of a level are dealt over
ROWS_HELD = 1 << 18  # counts that a task holds, of each shard, before it adds them up and sends what is still many

_IN_WORD = np.array([chr(b) not in PIECE_ENDS + SPACES for b in range(256)])
_ENDS = np.array([chr(b) in PIECE_ENDS for b in range(256)])
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SCALE = 1_000_000


class Field:
    """Which hashes are in a set, up to chance: one bit for the leading ``bits`` bits of each."""

    def __init__(self, bits: int, cells: np.ndarray):
        self.bits, self.cells = bits, cells

    def has(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes >> np.uint64(64 - self.bits)
        return (self.cells[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) != 0


def field_of(hashes: DataFrame, most_bits: int = MOST_BITS) -> tuple[int, np.ndarray]:
    """The set of the longs in ``h`` as (bits, cells): cells are put together in Spark, so that what reaches the driver is at most
    the whole field."""
    rows = hashes.count()
    bits = int(min(most_bits, max(16, (16 * max(1, rows) - 1).bit_length())))
    place = F.shiftrightunsigned("h", 64 - bits)
    cells = (
        hashes.select(F.shiftright(place, 6).alias("cell"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 as int))").alias("bit"))
        .groupBy("cell")
        .agg(F.bit_or("bit").alias("bit"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[cells["cell"].to_numpy()] = cells["bit"].to_numpy().view(np.uint64)
    return bits, out


class Runs:
    """The words of some texts with, for each, how many words follow it in its piece, and hashes of runs of words."""

    def __init__(self, texts: list[str | None], langs: np.ndarray):
        self.words: Words = words_of(texts, _IN_WORD, ascii_case=True)
        w = self.words
        self.owner = w.owners()
        ends = np.cumsum(_ENDS[w.data])
        self.next = np.zeros(len(w.hashes), bool)
        if len(w.hashes):
            self.next[:-1] = (ends[w.start[1:]] == ends[w.end[:-1] - 1]) & (self.owner[1:] == self.owner[:-1])
        # A phrase belongs to its language, so that goes into the hash.
        self.single = mix(w.hashes ^ langs.view(np.uint64)[self.owner]) if len(w.hashes) else w.hashes

    def level(self, size: int, below: Field | None) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of the runs of ``size`` words whose two runs of ``size - 1`` words are in ``below``."""
        first, hashes = np.arange(len(self.single)), self.single
        for length in range(2, size + 1):
            if len(first) < 2:
                return first[:0], hashes[:0]
            # The run from word i goes on if word i + length - 1 follows in the piece; its second part is the run from word i + 1.
            beside = np.flatnonzero((first[1:] == first[:-1] + 1) & self.next[first[1:] + length - 3])
            longer = mix(hashes[beside] * _FACTOR + hashes[beside + 1])
            if length == size and below is not None:
                good = below.has(hashes[beside]) & below.has(hashes[beside + 1])
                beside, longer = beside[good], longer[good]
            first, hashes = first[beside], longer
        return first, hashes

    def strings(self, first: np.ndarray, size: int) -> pa.Array:
        """The runs as texts, words joined by one space."""
        w = self.words
        word = (first[:, None] + np.arange(size)[None, :]).reshape(-1)
        lengths = w.end[word] - w.start[word] + 1  # with the byte that follows, which becomes the space
        stops = np.cumsum(lengths)
        at = np.arange(int(stops[-1]) if len(stops) else 0) + np.repeat(w.start[word] - (stops - lengths), lengths)
        data = w.data[at]
        data[stops - 1] = 32
        last = np.zeros(len(data), bool)
        last[stops[size - 1 :: size] - 1] = True
        whole = np.concatenate([[0], stops[size - 1 :: size] - np.arange(1, len(first) + 1)]).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(whole), pa.py_buffer(data[~last].tobytes()))


class _Counts:
    """Counts by hash, added up as they come."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, hashes: np.ndarray) -> None:
        found, n = np.unique(hashes, return_counts=True)
        self.parts.append((found, n))
        self.rows += len(found)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        hashes, n = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(hashes, kind="stable")  # runs that are in order already
        hashes, n = hashes[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])[: len(hashes)])
        found, total = hashes[first], np.add.reduceat(n, first) if len(first) else n
        self.parts, self.rows = [(found, total)], len(found)
        return found, total


def prepared(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(text, lang, lang_hash, shard): only what is mined, whatever other columns there are."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG))
    return docs.where(F.col("text").isNotNull()).select(
        "text", lang.alias("lang"), F.xxhash64(lang).alias("lang_hash"), F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int").alias("shard")
    )


def _by_shard(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str], np.ndarray, list[str]]]:
    shards = batch["shard"].to_numpy(zero_copy_only=False)
    hashes = batch["lang_hash"].to_numpy(zero_copy_only=False)
    for shard in np.unique(shards):
        rows = np.flatnonzero(shards == shard)
        part = batch.take(pa.array(rows))
        texts, langs = part["text"].to_pylist(), part["lang"].to_pylist()
        for piece in chunks(texts):
            yield int(shard), texts[piece], hashes[rows[piece]], langs[piece]


def _locally_frequent(texts: DataFrame, size: int, below, lowered: dict[int, int], parts: int) -> DataFrame:
    """(h): phrases of ``size`` words that reach their shard's lowered support in some shard, after the level below; each once.

    Hashes are dealt over ``parts`` by their leading bits. A row of the exchange holds all sorted hashes that a task has for a shard
    and part, with their counts, as bytes: a few large rows in place of one for each phrase.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(*below.value)
        held: dict[int, _Counts] = {}

        def send(shard: int) -> Iterator[pa.RecordBatch]:
            hashes, n = held.pop(shard).merged()
            part = ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)  # rises with the hash
            found, first = np.unique(part, return_index=True)
            ends = np.append(first[1:], len(part))
            n = n.astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(found), shard, np.int32)),
                    pa.array(found.astype(np.int32)),
                    pa.array([hashes[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()),
                    pa.array([n[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()),
                ],
                names=["shard", "part", "h", "n"],
            )

        for batch in slices(batches):
            for shard, part, langs, _ in _by_shard(batch):
                counts = held.setdefault(shard, _Counts())
                counts.add(Runs(part, langs).level(size, field)[1])
                if counts.rows > ROWS_HELD:
                    counts.merged()
                    if counts.rows > ROWS_HELD // 2:
                        yield from send(shard)
        for shard in list(held):
            yield from send(shard)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], _Counts] = {}
        for batch in batches:
            for shard, part, h, n in zip(*(batch[name].to_pylist() for name in ("shard", "part", "h", "n"))):
                counts = held.setdefault((shard, part), _Counts())
                counts.parts.append((np.frombuffer(h, np.uint64), np.frombuffer(n, np.int32)))
        found = []
        for shard, part in list(held):
            hashes, n = held.pop((shard, part)).merged()
            found.append(hashes[n >= lowered[shard]])
        if found:
            out = np.unique(np.concatenate(found)).view(np.int64)
            for at in range(0, len(out), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(out[at : at + (1 << 16)])], names=["h"])
        release_memory()

    rows = texts.mapInArrow(count, "shard int, part int, h binary, n binary")
    return rows.repartition(parts, "part").mapInArrow(frequent, "h long")


def _exact_counts(texts: DataFrame, sizes: dict[int, object]) -> DataFrame:
    """(lang, phrase, size, h, n): exact counts of phrases, keyed by their words. ``sizes``: a broadcast field of the candidates of
    each size, or None for all of that size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = {size: None if field is None else Field(*field.value) for size, field in sizes.items()}
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            table = pa.concat_tables(held).group_by(["h", "size"]).aggregate([("n", "sum"), ("lang", "min"), ("phrase", "min")])
            return table.rename_columns(["h", "size", "n", "lang", "phrase"]).select(["lang", "phrase", "size", "h", "n"])

        def send() -> Iterator[pa.RecordBatch]:
            if held:
                table = merged()
                held.clear()
                yield from table.combine_chunks().to_batches(max_chunksize=1 << 16)

        rows = 0
        for batch in slices(batches):
            for _, part, hashes, langs in _by_shard(batch):
                runs, names = Runs(part, hashes), pa.array(langs, pa.string())
                for size, field in fields.items():
                    first, found = runs.level(size, None)
                    if field is not None:
                        good = field.has(found)
                        first, found = first[good], found[good]
                    if not len(found):
                        continue
                    distinct, at, n = np.unique(found, return_index=True, return_counts=True)
                    held.append(
                        pa.table(
                            {
                                "lang": names.take(pa.array(runs.owner[first[at]])),
                                "phrase": runs.strings(first[at], size).cast(pa.string()),
                                "size": pa.array(np.full(len(distinct), size, np.int32)),
                                "h": pa.array(distinct.view(np.int64)),
                                "n": pa.array(n),
                            }
                        )
                    )
                    rows += len(distinct)
                if rows > ROWS_HELD:
                    held[:] = [merged()]
                    rows = held[0].num_rows
                    if rows > ROWS_HELD // 2:
                        yield from send()
                        rows = 0
        yield from send()

    rows = texts.mapInArrow(count, "lang string, phrase string, size int, h long, n long")
    return rows.groupBy("lang", "phrase").agg(F.first("size").alias("size"), F.first("h").alias("h"), F.sum("n").alias("n"))


def shard_bytes(texts: DataFrame) -> dict[int, int]:
    return {row["shard"]: row["size"] for row in texts.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("size")).collect()}


def lowered_supports(sizes: dict[int, int], support: int) -> dict[int, int]:
    """The lowered support of each shard: ceil(support * share) of the bytes, so that a phrase below it in every shard is below
    ``support`` in all."""
    total = sum(sizes.values())
    return {shard: max(1, -(-support * size // max(1, total))) for shard, size in sizes.items()}


def local_supports(texts: DataFrame, support: int) -> dict[int, int]:
    return lowered_supports(shard_bytes(texts), support)


def phrases(docs: DataFrame, support: int = 10, longest: int = 3, shards: int = SHARDS, cover: tuple[int, int] = (50, 100)) -> DataFrame:
    """(lang, phrase, size, a, l, r, k, n, score, covered): every phrase of 2 to ``longest`` words with ``support`` occurrences or more.

    ``docs`` needs text and lang; A-Z are lower-cased, pieces end at PIECE_ENDS, words are parted by SPACES. All counts are per lang
    (null: ``und``): ``a`` occurrences of the phrase, overlaps included, ``n`` of all words, ``l`` and ``r`` of the parts before and
    after the cut behind word ``k``, the cut with the lowest ``score`` = floor(1000000 * a * a / (l * r)), ties to the first. ``covered``:
    a longer phrase of the result contains this one and has ``cover`` (a fraction) of its occurrences at least.

    Null, empty and blank texts have no words. Equal rows all count. An empty table, or one without a frequent phrase, gives no
    rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    broadcast = spark.sparkContext.broadcast
    texts = prepared(docs, shards)
    words = stage(_exact_counts(texts, {1: None}).drop("size"), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    sizes = shard_bytes(texts)
    lowered = lowered_supports(sizes, support)
    parts = max(1, sum(sizes.values()) // BYTES_PER_PART)

    # First pass: what each shard finds frequent, level by level. A phrase of rare words is rare.
    below, fields, made = broadcast(field_of(words.where(F.col("n") >= support).select("h"))), {}, []
    for size in range(2, longest + 1):
        local = stage(_locally_frequent(texts, size, below, lowered, parts), "local")
        below = fields[size] = broadcast(field_of(local))
        made.append(local)
    # Second pass: exact counts of the union.
    if not fields:
        raise ValueError("longest must be 2 or more")
    frequent = stage(_exact_counts(texts, fields).where(F.col("n") >= support).drop("h"), "frequent")
    unstage(*made)

    counts = words.select("lang", "phrase", "n").unionByName(frequent.select("lang", "phrase", "n"))
    scored = _scored(frequent.withColumnRenamed("n", "a"), counts)
    out = scored.join(_covers(frequent), ["lang", "phrase"], "left").join(totals, "lang")
    share = F.lit(cover[1]) * F.coalesce(F.col("longer"), F.lit(0)) >= F.lit(cover[0]) * F.col("a")
    return out.select("lang", "phrase", "size", "a", "l", "r", "k", F.col("total").alias("n"), "score", share.alias("covered"))


def _part(first: Column, length: Column) -> Column:
    return F.array_join(F.slice("word", first, length), " ")


def _scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """Candidates with their lowest cut. Parts of a frequent phrase are frequent, so all are in ``counts``."""
    cuts = candidates.withColumn("word", F.split("phrase", " ")).select(
        "lang", "phrase", "size", "a", "word", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    )
    parts = cuts.select(
        "lang", "phrase", "size", "a", "k", _part(F.lit(1), F.col("k")).alias("left"), _part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right")
    )
    of = lambda name, out: counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(out))
    known = parts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    wide = lambda name: F.col(name).cast("decimal(20,0)")
    known = known.select("lang", "phrase", "size", "a", "k", "l", "r", wide("a").alias("aa"), wide("l").alias("ll"), wide("r").alias("rr"))
    score = F.expr(f"cast((aa * aa * {_SCALE}BD) div (ll * rr) as bigint)")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return known.groupBy("lang", "phrase", "size", "a").agg(lowest).select("lang", "phrase", "size", "a", "cut.*")


def _covers(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the most frequent longer candidate that contains the phrase."""
    inner = frequent.where("size > 2").withColumn("word", F.split("phrase", " "))
    lengths = inner.select("lang", "size", "word", F.col("n").alias("longer"), F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("length"))
    places = lengths.select(
        "lang", "word", "longer", "length", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("length") + 1)).alias("first")
    )
    held = places.select("lang", "longer", _part(F.col("first"), F.col("length")).alias("phrase"))
    return held.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))


def first_phrases(found: DataFrame, first: int = 2000, rows_per_bucket: int = 200_000) -> DataFrame:
    """The ``first`` phrases of each lang that are not covered, ranked from 1 by score, then count (both falling), then phrase. A lang is
    ranked in buckets by hash before what is left of it is ranked as one, so no task sorts all its phrases."""
    own = found.where(~F.col("covered"))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    buckets = max(1, -(-own.count() // rows_per_bucket))
    bucket = F.pmod(F.xxhash64("phrase"), F.lit(buckets))
    near = own.withColumn("bucket", bucket).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order)))
    best = near.where(F.col("rank") <= first).drop("bucket", "rank")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return best.withColumn("rank", rank).where(F.col("rank") <= first)
