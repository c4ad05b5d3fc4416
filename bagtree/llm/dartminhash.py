"""Near-duplicate documents by DartMinHash (Christiani 2020) on weighted word shingles.

An element of weight x owns the strip [0, x) of a plane whose other axis is rank. Darts lie in the plane as a Poisson process that
is fixed by hashes: a unit cell has Poisson(1) darts. A document throws the darts of its elements up to the rank at which it has
about ``k ln k + 2k``; each dart has a hashed coordinate, and the earliest dart of each of the k coordinates is the
signature. Two signatures agree in a coordinate with the probability of their weighted Jaccard similarity. Bands of
coordinates are joined; candidates are verified by the similarity itself.

Elements are shingles of five words, their weights how often they occur. With 32 bands of 4 coordinates a pair at similarity
0.8 shares no band once in 2 * 10**7 pairs.

A bucket of a band never gives all its pairs. First the members of each bucket are compared with its pivot, the member that
shares most buckets with others (of a group of copies that is the original or the like); what is verified merges classes. The buckets
that still hold several classes get more pivots; of those that are larger than that, all members outside the leading class are compared with
all members of other classes, block by block, each block in one task with every document in it once. So no link is lost, and a
large group of copies costs about one comparison for each member that is linked to its middle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bagtree.llm.components import components
from bagtree.llm.words import chunks, counted, mix, shingles_of, slices, words_of
from bagtree.sources.scratch import stage, unstage

K = 128
BANDS = 32
PIVOTS = (1,)  # per bucket, compared with all its members, round by round; more rounds mean more jobs
_OUTER, _INNER = 256, 2048
_C1, _C2, _C3 = (np.uint64(x) for x in (0xD1B54A32D192ED03, 0xABC98388FB8FAC03, 0x8CB92BA72F3D8DD7))
# P(Poisson(1) <= n) as thresholds for 53-bit fractions; fixed values by the rule below.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(n) for n in range(18)])
_FRACTION_BITS = 26


def dart_signatures(hashes: np.ndarray, weights: np.ndarray, owner: np.ndarray, docs: int, k: int = K) -> np.ndarray:
    """(docs, k) signature values, for elements (hash, weight > 0, owner); rows of documents without elements are 0."""
    signatures = np.zeros((docs, k), np.uint64)
    mass = np.bincount(owner, weights, docs)
    darts = k * math.log(k) + 2 * k
    left = np.flatnonzero(mass > 0)
    while len(left):
        chosen = np.zeros(docs, bool)
        chosen[left] = True
        mine = chosen[owner]
        values, full = _throw(hashes[mine], weights[mine], owner[mine], np.where(mass > 0, darts / np.maximum(mass, 1e-300), 0), docs, k)
        good = left[full[left]]
        signatures[good] = values[good]
        left = left[~full[left]]  # a coordinate got no dart: throw twice as many; earlier ones stay the same
        darts *= 2
    return signatures


def _throw(hashes, weights, owner, reach, docs, k):
    ranks = np.maximum(1, np.ceil(reach)).astype(np.int64)[owner]
    widths = np.ceil(weights).astype(np.int64)
    cells = ranks * widths
    element = np.repeat(np.arange(len(hashes)), cells)
    place = np.arange(len(element)) - np.repeat(np.cumsum(cells) - cells, cells)
    a, b = np.divmod(place, ranks[element])
    cell = mix(hashes[element] + a.astype(np.uint64) * _C1 + b.astype(np.uint64) * _C2)
    count = np.searchsorted(_POISSON, (cell >> np.uint64(11)) * 2.0**-53, side="right")
    at = np.repeat(np.arange(len(cell)), count)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    dart = mix(cell[at] + (nth + 1).astype(np.uint64) * _C3)
    element = element[at]
    fraction = dart >> np.uint64(64 - _FRACTION_BITS)
    rank = (b[at].astype(np.uint64) << np.uint64(_FRACTION_BITS)) | fraction
    inside = rank * 2.0**-_FRACTION_BITS < reach[owner[element]]
    if weights.dtype.kind == "f":
        inside &= a[at] + (dart & np.uint64(0xFFFFFF)) * 2.0**-24 < weights[element]
    rank, who = rank[inside], owner[element[inside]]
    coordinate = (mix(dart[inside] + _C1) % np.uint64(k)).astype(np.int64)
    # The earliest of each (document, coordinate): sort (slot, rank) as one number; the rank also tells darts apart.
    key = ((who * k + coordinate).astype(np.uint64) << np.uint64(40)) | np.minimum(rank, np.uint64((1 << 40) - 1))
    key.sort()
    slot = (key >> np.uint64(40)).astype(np.int64)
    first = np.ones(len(key), bool)
    first[1:] = slot[1:] != slot[:-1]
    values = np.zeros(docs * k, np.uint64)
    filled = np.zeros(docs * k, bool)
    values[slot[first]] = key[first] & np.uint64((1 << 40) - 1)
    filled[slot[first]] = True
    return values.reshape(docs, k), filled.reshape(docs, k).all(1)


def band_hashes(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(docs, bands): one 64-bit hash for each band's coordinates and its number."""
    docs, k = signatures.shape
    parts = signatures.reshape(docs, bands, k // bands)
    out = np.tile(np.arange(bands, dtype=np.uint64) * _C2, (docs, 1))
    for i in range(k // bands):
        out = mix(out + parts[:, :, i] * _C1)
    return out.view(np.int64)


def weighted_shingles(texts: list[str | None], words: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """(slice of texts, hash, count, owner in the slice), in pieces of bounded size."""
    for piece in chunks(texts):
        hashes, owner = shingles_of(words_of(texts[piece]), words)
        distinct, who, count = counted(hashes, owner)
        yield piece, distinct, count, who


def _signed(batches: Iterator[pa.RecordBatch], words: int, k: int, bands: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = batch["text"].to_pylist()
        for piece, hashes, count, who in weighted_shingles(texts, words):
            docs = piece.stop - piece.start
            keys = band_hashes(dart_signatures(hashes, count, who, docs, k), bands)
            bare = np.bincount(who, minlength=docs) == 0
            rows = [None if empty else row for empty, row in zip(bare, keys)]
            part = batch.slice(piece.start, docs)
            yield pa.RecordBatch.from_arrays(
                [part["key"], part["node"], pa.array(rows, pa.list_(pa.int64()))], names=["key", "node", "bands"]
            )


def _element_sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Each document's shingles as a set of numbers: the nth occurrence of a shingle is an element of its own, so the plain Jaccard
    similarity of the sets is the weighted one of the shingles."""
    for batch in slices(batches):
        for piece, hashes, count, who in weighted_shingles(batch["text"].to_pylist(), words):
            nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            elements = mix(np.repeat(hashes, count) + nth.astype(np.uint64) * _C3).view(np.int64)
            sizes = np.bincount(who, count, piece.stop - piece.start).astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            arrays = pa.ListArray.from_arrays(pa.array(offsets), pa.array(elements))
            yield pa.RecordBatch.from_arrays(
                [batch["node"].slice(piece.start, len(sizes)), arrays], names=["node", "elements"]
            )


def document_key() -> Column:
    """doc_id, or where it is null a hash of the text, above 2**62 and so above the ids."""
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit("null doc_id"), F.coalesce("text", F.lit(""))), 2) + F.lit(1 << 62)
    return F.coalesce(F.col("doc_id").cast("long"), hashed)


def text_node() -> Column:
    """A hash of the text: each distinct text is a node, whatever documents hold it."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def near_duplicates(
    documents: DataFrame, words: int = 5, similarity: float = 0.8, k: int = K, bands: int = BANDS
) -> DataFrame:
    """(key, doc_id, class_id, class_size): documents linked by equal texts or by chains of pairs with a weighted Jaccard
    similarity of ``similarity`` or more share a class; class_id is the least key in it, class_size its number of keys.

    Words are runs of letters and digits, lower-cased. Texts of fewer words have one shingle of all of them; texts without words, null among
    them as the empty text, are only like equal ones. doc_id is a document's key: rows that share one are one document, with
    one row in the result, whose texts all count. Rows without a doc_id are one document per distinct text. Other columns are
    not read. An empty table gives an empty result.
    """
    of_key, found = _linked_texts(documents, words, similarity, k, bands)
    several = of_key.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    links = of_key.join(several.select("key", "a"), "key").where("a <> node").select("a", F.col("node").alias("b"))
    classes = _named_by_key(of_key, components(found.unionByName(links))).groupBy("key").agg(F.min("class_id").alias("class_id"))
    sizes = classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size"))
    doc_id = documents.select(document_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"))
    nulls = doc_id.where("doc_id IS NULL").select("key").distinct().withColumn("_null", F.lit(True))
    named = classes.join(sizes, "class_id").join(nulls, "key", "left")
    return named.select(
        "key", F.when(F.col("_null").isNull(), F.col("key")).alias("doc_id"), "class_id", "class_size"
    )


def _linked_texts(documents: DataFrame, words: int, similarity: float, k: int, bands: int) -> tuple[DataFrame, DataFrame]:
    """The distinct (key, node) of the rows, and verified links (a, b) between nodes."""
    narrow = documents.select("doc_id", "text").select(
        document_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"), text_node().alias("node")
    )
    signed = stage(narrow.mapInArrow(lambda it: _signed(it, words, k, bands), "key long, node long, bands array<long>"), "signed")
    # Of the documents with one text, the one with the least key gives it.
    exact = stage(
        signed.groupBy("node").agg(F.min("key").alias("key"), F.first("bands", ignorenulls=True).alias("bands")), "exact"
    )
    of_key = stage(signed.select("key", "node").distinct(), "of_key")
    unstage(signed)
    members = _buckets(exact)
    found = stage(_verified(members, documents, exact, words, similarity), "found")
    unstage(exact, members)
    return of_key, found


def _named_by_key(of_key: DataFrame, comps: DataFrame) -> DataFrame:
    """(key, node, comp, class_id): class_id is the least key of a component of texts."""
    placed = of_key.join(comps, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    return placed.join(placed.groupBy("comp").agg(F.min("key").alias("class_id")), "comp")


def _buckets(exact: DataFrame) -> DataFrame:
    """(bucket, node, n) of the band buckets with n > 1 nodes; of buckets with the same members only one."""
    rows = exact.where("bands IS NOT NULL").select("node", F.explode("bands").alias("bucket")).distinct()
    sizes = rows.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("node").alias("least"), F.expr("bit_xor(xxhash64(node))").alias("who")
    )
    one_of_each = sizes.where("n > 1").groupBy("n", "least", "who").agg(F.min("bucket").alias("bucket"))
    return stage(rows.join(one_of_each.select("bucket", "n"), "bucket"), "members")


def _verified(members: DataFrame, documents: DataFrame, exact: DataFrame, words: int, similarity: float) -> DataFrame:
    """Verified pairs (a, b) that connect every two nodes that a chain of similar pairs within buckets connects."""
    degrees = stage(members.groupBy("node").agg(F.sum("n").alias("degree")), "degrees")
    texts = (
        documents.select(document_key().alias("key"), text_node().alias("node"), F.coalesce("text", F.lit("")).alias("text"))
        .join(exact.join(degrees, "node").select("key", "node"), ["key", "node"], "left_semi")
        .groupBy("node")
        .agg(F.min("text").alias("text"))
    )
    sets = stage(texts.mapInArrow(lambda it: _element_sets(it, words), "node long, elements array<long>"), "sets")
    edges: list[DataFrame] = []
    tested: DataFrame | None = None
    comps: DataFrame | None = None
    for pivots in PIVOTS:
        left = _unsettled(members, comps)
        best = left.join(degrees, "node")
        order = Window.partitionBy("bucket").orderBy(F.desc("degree"), F.xxhash64("node"), "node")
        chosen = best.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= pivots)
        pairs = (
            chosen.select("bucket", F.col("node").alias("pivot"), F.col("comp").alias("pivot_comp"))
            .join(left, "bucket")
            .where("pivot_comp <> comp")
            .select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b"))
            .distinct()
        )
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        checked = stage(_compare(pairs, sets, similarity), "checked")
        unstage(left)
        tested = checked.select("a", "b")
        edges.append(checked.where("linked").select("a", "b"))
        unstage(comps)
        comps = stage(components(_union(edges)), "comps")
    left = _unsettled(members, comps)
    edges.append(stage(_compare_blocks(left.where(F.col("n") > PIVOTS[-1]), sets, similarity), "block_links"))
    unstage(left, sets, degrees, comps)
    return _union(edges)


def _unsettled(members: DataFrame, comps: DataFrame | None) -> DataFrame:
    """(bucket, node, n, comp) of the buckets that hold several classes."""
    placed = members.withColumn("comp", F.col("node"))
    if comps is not None:
        named = comps.select("node", F.col("comp").alias("_comp"))
        placed = members.join(named, "node", "left").select("bucket", "node", "n", F.coalesce("_comp", "node").alias("comp"))
    mixed = placed.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y")
    return stage(placed.join(mixed.select("bucket"), "bucket"), "unsettled")


def _compare(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, linked)."""
    of_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("elements").alias("of_b")), "b")
    both = of_b.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("of_a")), "a")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    union = F.size("of_a") + F.size("of_b") - shared
    return both.select("a", "b", (shared >= F.lit(similarity) * union - F.lit(1e-9)).alias("linked"))


def _compare_blocks(left: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between members of different classes of a bucket, of each node one for each class it is linked to.

    The least class of a bucket leads it. All nodes of the buckets that a class leads are compared with those of them that are in
    other classes, ``_OUTER`` times ``_INNER`` of them in a task.
    """
    leads = left.groupBy("bucket").agg(F.min("comp").alias("lead"))
    placed = left.join(leads, "bucket").select("lead", "node", "comp").distinct()
    sizes = placed.groupBy("lead").agg(
        F.ceil(F.count(F.lit(1)) / _INNER).cast("int").alias("inner"),
        F.ceil(F.count(F.when(F.col("comp") != F.col("lead"), 1)) / _OUTER).cast("int").alias("outer"),
    )
    spread = placed.join(sizes, "lead").withColumn("_in", F.pmod(F.xxhash64("node"), "inner").cast("int")).withColumn(
        "_out", F.pmod(F.xxhash64(F.lit(1), "node"), "outer").cast("int")
    )
    # Small leads share a task, about as many nodes as a block has.
    together = max(1, left.count() // _INNER)
    alone = (F.col("inner") > 1) | (F.col("outer") > 1)
    shared = F.pmod(F.xxhash64(F.lit(2), "lead"), F.lit(together))
    spread = spread.withColumn("task", F.when(alone, F.xxhash64("lead")).otherwise(shared))
    every = [F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name) for n, name in (("outer", "x"), ("inner", "y"))]
    kept = ["task", "lead", "node", "comp"]
    inner = spread.select(*kept, F.lit(False).alias("outside"), every[0], F.col("_in").alias("y"))
    outer = spread.where("comp <> lead").select(*kept, F.lit(True).alias("outside"), F.col("_out").alias("x"), every[1])
    rows = inner.unionByName(outer).join(sets, "node")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        return _block_links(frame, similarity)

    found = rows.groupBy("task", "x", "y").applyInPandas(compare, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _block_links(frame: pd.DataFrame, similarity: float) -> pd.DataFrame:
    inside = frame[~frame["outside"]]
    nodes, comps, leads = (inside[c].to_numpy() for c in ("node", "comp", "lead"))
    sizes = np.array([len(e) for e in inside["elements"]], np.int64)
    owner = np.repeat(np.arange(len(nodes)), sizes)
    elements = np.concatenate([*inside["elements"], np.empty(0, np.int64)]).astype(np.int64)
    order = np.argsort(elements, kind="stable")
    elements, owner = elements[order], owner[order]
    links = []
    for row in frame[frame["outside"]].itertuples():
        own = np.asarray(row.elements)
        begin = np.searchsorted(elements, own, side="left")
        length = np.searchsorted(elements, own, side="right") - begin
        at = np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())
        shared = np.bincount(owner[at], minlength=len(nodes))
        linked = shared >= similarity * (sizes + len(own) - shared) - 1e-9
        linked = np.flatnonzero(linked & (comps != row.comp) & (leads == row.lead))
        _, first = np.unique(comps[linked], return_index=True)
        links += [(row.node, int(nodes[i])) for i in linked[first]]
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def representatives(
    documents: DataFrame, words: int = 5, similarity: float = 0.8, k: int = K, bands: int = BANDS
) -> DataFrame:
    """One row of each class of near-duplicate texts, of the document with the least key, with all of its columns.

    Different texts of one doc_id that are not near duplicates all stay. Of rows with the same doc_id and text the least (by all
    columns) stays.
    """
    of_key, found = _linked_texts(documents, words, similarity, k, bands)
    placed = _named_by_key(of_key, components(found)).where("key = class_id")
    kept = placed.groupBy("comp", F.col("key").alias("_key")).agg(F.min("node").alias("_node")).select("_key", "_node")
    fields = [(f"`{f.name}`", f.dataType) for f in documents.schema.fields]
    row = F.struct(*[F.col(name) for name, _ in fields])
    # Maps have no order: they compare as text.
    order = F.struct(*[F.col(name) if _has_order(kind) else F.to_json(F.struct(F.col(name))) for name, kind in fields])
    keyed = documents.select(document_key().alias("_key"), text_node().alias("_node"), row.alias("row"), order.alias("order"))
    one = keyed.groupBy("_key", "_node").agg(F.min_by("row", "order").alias("row"))
    return one.join(kept, ["_key", "_node"], "left_semi").select("row.*")


def _has_order(kind) -> bool:
    return not any(part in kind.simpleString() for part in ("map<", "variant", "interval"))
