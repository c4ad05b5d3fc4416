"""Benchmark decontamination: pairs of neighbouring words as seeds, then Smith-Waterman alignment.

A seed is two words of an item, in their order and within ``seed_words`` words of each other; in a document they may be as far apart.
An alignment that scores ``threshold`` of an exact copy of n words holds such seeds at ``threshold * n - 1`` places of the item at
least: two matched words in a row that are no seed have two edits between them, which cost what a match gains. So the item
is laid over a passage only where that many seeds lie within reach of each other, and no copy is lost by that, wherever its
edits are. (A single word of a longer item is no copy. An item of one word is found by it.)

A first pass over the documents counts in how many of them each seed occurs. As many seeds are needed, the most frequent places of an item
can be left out and the rest still holds all but that many; the counts decide only which, so that frequent pairs cost little. An
item that is copied into a third of all documents is found in each of them. The benchmark goes to the tasks in blocks of
bounded size, with two passes for a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagtree.llm.words import Words, chunks, mix, slices, words_of

SEED_WORDS = 3
SEGMENT_WORDS = 4
THRESHOLD = 0.5
BLOCK_BYTES = 4 << 20
_MATCH, _MISS = 2, 1  # a mismatch and a gap cost the same
_CELLS = 1 << 20  # words of passages aligned at a time
_ORDER, _ALONE = np.uint64(0xABC98388FB8FAC03), np.uint64(0xD1B54A32D192ED03)


@dataclass
class Items:
    """A block of test items: their ids, word hashes, and seeds (hash, item, place), sorted by hash."""

    ids: list
    words: list[np.ndarray]
    gram: np.ndarray
    item: np.ndarray
    place: np.ndarray
    gaps: list[int]  # from a seed's first word to its second; 0 for items of one word
    needed: np.ndarray  # how many of its seeds a copy of each item holds at least

    def distinct(self) -> np.ndarray:
        return np.unique(self.gram)

    def chosen(self, seeds: np.ndarray) -> Items:
        """With only the seeds numbered by ``seeds``."""
        return replace(self, gram=self.gram[seeds], item=self.item[seeds], place=self.place[seeds])


def items_of(ids: list, texts: list[str | None], seed_words: int) -> Items:
    """Items without words are left out."""
    words = words_of(texts)
    parts = [words.hashes[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
    kept = [i for i, w in enumerate(parts) if len(w)]
    words = words_of([texts[i] for i in kept])
    length = np.diff(words.first)
    gaps = ([0] if (length == 1).any() else []) + (list(range(1, max(3, seed_words))) if (length > 1).any() else [])
    gram, item, at = _seeds(words, gaps)
    place = at - words.first[item]
    single = gram == _alone(words.hashes[at])
    order = np.lexsort((place, item, gram))
    order = order[(single == (length[item] == 1))[order]]
    gram, item, place = gram[order], item[order], place[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (item[1:] != item[:-1]) | (place[1:] != place[:-1])
    return Items(
        [ids[i] for i in kept], [parts[i] for i in kept], gram[new], item[new], place[new], gaps, np.ones(len(kept), np.int64)
    )


def _alone(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes ^ _ALONE)


def _seeds(words: Words, gaps: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, number of the first word) of the texts' words so far apart, or for 0 of the single words."""
    out, owners = [(np.empty(0, np.uint64), np.empty(0, int), np.empty(0, int))], words.owners()
    for gap in gaps:
        at = np.arange(max(0, len(owners) - gap))
        at = at[owners[at] == owners[at + gap]]
        first = words.hashes[at]
        out.append((mix(first * _ORDER + words.hashes[at + gap]) if gap else _alone(first), owners[at], at))
    return tuple(np.concatenate(x) for x in zip(*out))


def _among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Numbers of the hashes that are in the sorted ``known``. A table of leading bits settles most of the others."""
    bits = np.uint64(20)
    table = np.zeros(1 << 20, bool)
    table[(known >> (np.uint64(64) - bits)).astype(np.int64)] = True
    maybe = np.flatnonzero(table[(hashes >> (np.uint64(64) - bits)).astype(np.int64)])
    at = np.minimum(np.searchsorted(known, hashes[maybe]), max(0, len(known) - 1))
    return maybe[known[at] == hashes[maybe]] if len(known) else maybe[:0]


def document_frequencies(documents: DataFrame, items: Items) -> dict[int, int]:
    """In how many documents each seed of the block occurs (those that do)."""
    known, gaps = items.distinct(), items.gaps
    shared = documents.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        seen = np.zeros(len(known), np.int64)
        for batch in slices(batches):
            texts = batch["text"].to_pylist()
            for piece in chunks(texts):
                hashes, owner, _ = _seeds(words_of(texts[piece]), gaps)
                hit = _among(hashes, known)
                number = np.searchsorted(known, hashes[hit])
                once = np.unique(owner[hit] * len(known) + number)
                seen += np.bincount(once % max(1, len(known)), minlength=len(known))
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], names=["number", "docs"])

    rows = documents.select("text").mapInArrow(count, "number long, docs long").groupBy("number").agg(F.sum("docs").alias("docs"))
    found = {int(known[r["number"]]): r["docs"] for r in rows.collect()}  # at most the block's seeds
    shared.destroy()
    return found


def needed_seeds(items: Items, docs: dict[int, int], threshold: float) -> Items:
    """Without the seeds that occur nowhere, and without those of the most frequent places of each item: half as many places as
    every copy has seeds at, so that every copy keeps the other half."""
    frequency = np.array([docs.get(int(g), 0) for g in items.gram], np.int64)
    length = np.array([len(w) for w in items.words], np.int64)
    least = np.maximum(1, np.ceil(threshold * length - 1 - 1e-9).astype(np.int64))
    left_out = least // 2
    spot, number = np.unique(items.item * (length.max(initial=0) + 1) + items.place, return_inverse=True)
    total = np.zeros(len(spot), np.int64)
    np.add.at(total, number, frequency)
    item = spot // (length.max(initial=0) + 1)
    order = np.lexsort((spot, -total, item))
    rank = np.empty(len(spot), np.int64)
    rank[order] = np.arange(len(spot)) - np.searchsorted(item, item)
    kept = (rank[number] >= left_out[items.item]) & (frequency > 0)
    return replace(items.chosen(np.flatnonzero(kept)), needed=least - left_out)


def rare_seeds(items: Items, docs: dict[int, int], segment: int) -> Items:
    """The rarest seed of each segment of each item, ties to the first. The search does not thin its seeds like this: edited copies
    may have lost just these."""
    frequency = np.array([docs.get(int(g), 0) for g in items.gram], np.int64)
    order = np.lexsort((items.place, frequency, items.place // segment, items.item))
    item, part = items.item[order], (items.place // segment)[order]
    first = np.ones(len(order), bool)
    first[1:] = (item[1:] != item[:-1]) | (part[1:] != part[:-1])
    return items.chosen(np.sort(order[first]))


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> np.ndarray:
    """Best local alignment of each item with its passage, as a share of an exact copy's."""
    scores = np.zeros(len(items))
    lengths = np.array([len(w) for w in items], np.int64)
    widths = np.array([len(w) for w in passages], np.int64)
    order = np.lexsort((lengths, widths))
    at = 0
    while at < len(order):
        part = order[at : at + 256]
        part = part[: max(1, int(np.searchsorted(widths[part] * np.arange(1, len(part) + 1), _CELLS)))]
        at += len(part)
        width = max(len(passages[i]) for i in part)
        length = max(len(items[i]) for i in part)
        item, passage = np.zeros((len(part), length), np.uint64), np.ones((len(part), width), np.uint64)
        for row, i in enumerate(part):
            item[row, : len(items[i])], passage[row, : len(passages[i])] = items[i], passages[i]
        above = np.zeros((len(part), width + 1), np.int32)
        best = np.zeros(len(part), np.int32)
        slope = np.arange(width, dtype=np.int32) * _MISS
        for n in range(length):
            step = np.where(item[:, n : n + 1] == passage, _MATCH, -_MISS).astype(np.int32)
            here = np.maximum(0, np.maximum(above[:, :-1] + step, above[:, 1:] - _MISS))
            # A gap from any earlier word: the best of (value + slope) so far, less the slope.
            here = np.maximum.accumulate(here + slope, axis=1) - slope
            above[:, 1:] = here
            np.maximum(best, here.max(1), out=best)
        scores[part] = best / (_MATCH * np.array([len(items[i]) for i in part]))
    return scores


def _reach(length: np.ndarray, threshold: float) -> np.ndarray:
    """The most words that an alignment of the threshold can insert or pass over: each costs ``_MISS`` of what all matches score."""
    return np.floor(_MATCH * (1 - threshold) * length / _MISS + 1e-9).astype(np.int64)


def leaks_of(texts: list[str | None], items: Items, threshold: float) -> list[tuple[int, int, float, int, int]]:
    """(text, item, score, first word, last word of the passage looked at) of the leaks, one for each text and item."""
    found = []
    known, starts = np.unique(items.gram, return_index=True)
    ends = np.append(starts[1:], len(items.gram))
    for piece in chunks(texts):
        words = words_of(texts[piece])
        hashes, owner, at = _seeds(words, items.gaps)
        hit = _among(hashes, known)
        if not len(hit):
            continue
        seed = np.searchsorted(known, hashes[hit])
        times = ends[seed] - starts[seed]
        entry = np.repeat(starts[seed], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        text, item = np.repeat(owner[hit], times), items.item[entry]
        shift = np.repeat(at[hit], times) - items.place[entry]  # where the item would begin
        order = np.lexsort((shift, item, text))
        text, item, shift = text[order], item[order], shift[order]
        length = np.array([len(w) for w in items.words])[item]
        slack = _reach(length, threshold)
        # A copy begins with a seed that has enough others after it in reach.
        ahead = np.arange(len(text)) + items.needed[item] - 1
        there = np.minimum(ahead, len(text) - 1)
        full = (ahead == there) & (text[there] == text) & (item[there] == item) & (shift[there] - shift <= slack)
        text, item, shift, length, slack = (x[full] for x in (text, item, shift, length, slack))
        if not len(text):
            continue
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (shift[1:] - shift[:-1] > slack[1:])
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(text)) - 1
        low = np.maximum(shift[begin] - slack[begin], words.first[text[begin]])
        high = np.minimum(shift[last] + length[begin] + slack[begin], words.first[text[begin] + 1])
        scores = align([items.words[i] for i in item[begin]], [words.hashes[a:b] for a, b in zip(low, high)])
        best: dict[tuple[int, int], tuple] = {}
        for n in np.flatnonzero(scores >= threshold - 1e-12):
            key = int(text[begin[n]]) + piece.start, int(item[begin[n]])
            base = int(words.first[text[begin[n]]])
            if key not in best or scores[n] > best[key][0]:
                best[key] = float(scores[n]), int(low[n]) - base, int(high[n]) - 1 - base
        found += [(*key, *value) for key, value in best.items()]
    return found


def _blocks(documents: DataFrame, benchmark: DataFrame, threshold: float, seed_words: int, block_bytes: int) -> Iterator[Items]:
    """The benchmark's items with the seeds to look up, block by block."""
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    for number in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number).orderBy("item_id", "text").collect()
        block = items_of([r["item_id"] for r in rows], [r["text"] for r in rows], seed_words)
        if block.ids:
            yield needed_seeds(block, document_frequencies(documents, block), threshold)


def _over_blocks(documents: DataFrame, benchmark: DataFrame, options: tuple, run: Callable) -> Iterator[DataFrame]:
    for items in _blocks(documents, benchmark, *options):
        shared = documents.sparkSession.sparkContext.broadcast(items)
        yield run(documents, shared)


def leaks(
    documents: DataFrame,
    benchmark: DataFrame,
    threshold: float = THRESHOLD,
    seed_words: int = SEED_WORDS,
    segment: int = SEGMENT_WORDS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word): the documents (doc_id, text) that hold a copy of an item (item_id, text).

    ``score`` is 1 for an exact copy; ``first_word`` to ``last_word`` is the passage that was aligned, in words from 0. Case and
    punctuation do not count. Null and empty texts and items have no copies. Rows with the same ids (null included)
    give one row, the best. Other columns are not read; an empty table on either side gives an empty result. ``segment`` no
    longer thins the seeds and has no effect.
    """

    def run(docs: DataFrame, shared) -> DataFrame:
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                rows = leaks_of(batch["text"].to_pylist(), shared.value, threshold)
                text, item, score, first, last = zip(*rows) if rows else ((), (), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].take(pa.array(text, pa.int64())).cast(pa.int64()),
                        pa.array([shared.value.ids[i] for i in item], pa.int64()),
                        pa.array(score, pa.float64()),
                        pa.array(first, pa.int64()),
                        pa.array(last, pa.int64()),
                    ],
                    names=["doc_id", "item_id", "score", "first_word", "last_word"],
                )

        return docs.select("doc_id", "text").mapInArrow(
            find, "doc_id long, item_id long, score double, first_word long, last_word long"
        )

    found = None
    for table in _over_blocks(documents, benchmark, (threshold, seed_words, block_bytes), run):
        found = table if found is None else found.unionByName(table)
    if found is None:
        schema = "doc_id long, item_id long, score double, first_word long, last_word long"
        return documents.sparkSession.createDataFrame([], schema)
    best = F.max(F.struct("score", -F.col("first_word"), -F.col("last_word"))).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "best.score", (-F.col("best.col2")).alias("first_word"), (-F.col("best.col3")).alias("last_word")
    )


def without_leaks(
    documents: DataFrame,
    benchmark: DataFrame,
    threshold: float = THRESHOLD,
    seed_words: int = SEED_WORDS,
    segment: int = SEGMENT_WORDS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The documents that hold no copy of an item, with all their columns; rows are kept or dropped one by one."""

    def run(docs: DataFrame, shared) -> DataFrame:
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                good = np.ones(batch.num_rows, bool)
                good[[row[0] for row in leaks_of(batch["text"].to_pylist(), shared.value, threshold)]] = False
                yield batch.filter(pa.array(good))

        return docs.mapInArrow(keep, docs.schema)

    kept = documents
    for items in _blocks(documents, benchmark, threshold, seed_words, block_bytes):
        kept = run(kept, documents.sparkSession.sparkContext.broadcast(items))
    return kept
