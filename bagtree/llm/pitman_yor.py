"""Language-model scoring: a hierarchical Pitman-Yor model (Teh 2006) of words after words, seated by Gibbs sampling.

Every word opens a context restaurant; what follows it sits there. All context restaurants share one parent, whose customers are
their tables; its own tables draw from a base measure, half of it on the unknown word, half spread over the words of the training
rows.

Given the totals of the restaurants, seatings of different words do not depend on each other. So words are hashed to parts; a
Gibbs sweep over a part draws the number of tables of every (context, word) given the word's probability in the parent, then the
word's tables in the parent, and so on; the totals of the contexts are summed up after each round of sweeps and sent to the next.
The predictive probability is linear in the tables and in the parent's probability, so those are averaged over the sweeps
for it.

Totals travel in two ways. Contexts with more than ``context_share`` of the training tokens (at most ``1 / context_share``) have
numbers, and their totals are broadcast. All other contexts are hashed to context parts: every part sends its sums by
context there and gets back the totals of the contexts that it holds, so no task or broadcast holds those of all words.

Data flow: one pass counts words. One pass packs each chunk of documents into compressed postings by part. Words with more than
``hot_share`` of the tokens (at most ``1 / hot_share``) do not go to a part of their own hash. After a numbered context, their counts are
summed before they are shuffled, and they are scored where their documents are; after another context, they go to a part by the context's
hash, and seats there are drawn given the word's probability in the parent after the round before. Parts score their
postings and send one sum per document, added up over many parts first. All sizes in a task are bounded by the chunk, the part and the
shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bagtree.llm.words import chunks, words_of
from bagtree.sources.scratch import scratch_path, stage, unstage

CONTEXT_SHARE = 2.5e-4
HOT_SHARE = 1e-3
CHUNK_BYTES = 12 << 20
PART_TOKENS = 1_000_000
STRENGTH = 1.0
END = np.uint64(0x5EED0E4D5EED0E4D)
PIECE_ROWS = 1 << 16  # rows of a chunk have numbers of 16 bits
KEY_BITS = 40  # of a context's hash; with 10**9 words one in 1,000 shares its restaurant
_RARE = np.uint64(1 << 47)  # set in the keys of contexts without a number, whose lowest bits are those of the hash
_SMALL = 20  # tables of up to so many customers are drawn exactly
_TOKEN_BYTES = np.ones(256, bool)
_TOKEN_BYTES[[0x20, *range(0x09, 0x0E)]] = False


# Packing arrays into one compressed value.

_codec = pa.Codec("zstd", 1)


def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(x for a in arrays for x in (ord(a.dtype.char), len(a)))], np.int64)
    raw = b"".join([head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])
    return len(raw).to_bytes(8, "little") + _codec.compress(raw, asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = _codec.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * n, 8)
    at, out = 8 + 16 * n, []
    for char, length in head.reshape(n, 2):
        dtype = np.dtype(chr(char))
        out.append(np.frombuffer(raw, dtype, length, at))
        at += dtype.itemsize * int(length)
    return out


# Tokens.


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text): the words of each text and one end, A-Z lower-cased."""
    hashes, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for piece in chunks(texts):
        words = words_of(texts[piece], _TOKEN_BYTES, ascii_case=True)
        owner = words.owners()
        part = np.full(len(words.hashes) + piece.stop - piece.start, END, np.uint64)
        part[np.arange(len(owner)) + owner] = words.hashes
        hashes.append(part)
        counts.append(np.diff(words.first) + 1)
    return np.concatenate(hashes), np.repeat(np.arange(len(texts)), np.concatenate(counts))


@dataclass
class Vocabulary:
    """Totals of the training tokens and the frequent words: ids from 1 in order of their hashes, 0 for all others."""

    tokens: int
    words: int
    contexts: np.ndarray
    hot: np.ndarray  # of each id (0 included): the number of the hot word, -1 if it is none
    hot_counts: np.ndarray  # training tokens of each hot word

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.uint16)
        if len(self.contexts):
            table = np.zeros(1 << 16, bool)
            table[(self.contexts >> np.uint64(48)).astype(np.int64)] = True
            maybe = np.flatnonzero(table[(hashes >> np.uint64(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.contexts, hashes[maybe]), len(self.contexts) - 1)
            good = self.contexts[at] == hashes[maybe]
            out[maybe[good]] = at[good] + 1
        return out

    def keys(self, hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """48 bits that tell contexts apart: the id, or for words without one their hash under ``_RARE``."""
        return np.where(ids > 0, ids.astype(np.uint64), (hashes >> np.uint64(64 - KEY_BITS)) | _RARE)


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Batches cut and put together so that a piece has about ``size`` bytes of text and at most ``PIECE_ROWS`` rows."""
    waiting, total = [], 0
    for batch in batches:
        sizes = pc.binary_length(batch["text"]).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        sizes = np.maximum(sizes, -(-size // PIECE_ROWS))
        ends, begin = np.cumsum(sizes), 0
        while begin < batch.num_rows:
            before = ends[begin - 1] if begin else 0
            stop = int(np.searchsorted(ends, before + size - total, side="left")) + 1
            part = batch.slice(begin, stop - begin)
            waiting.append(part)
            total += int(ends[begin + part.num_rows - 1] - before)
            begin += part.num_rows
            if total >= size:
                yield pa.Table.from_batches(waiting)
                waiting, total = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in _gathered(batches, CHUNK_BYTES):
        hashes, count = np.unique(tokens_of(piece["text"].to_pylist())[0], return_counts=True)
        for at in range(0, len(hashes), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes[part].view(np.int64)), pa.array(count[part].astype(np.int64))], names=["word", "n"]
            )


def vocabulary(training: DataFrame, context_share: float, hot_share: float) -> Vocabulary:
    """From all training rows (text)."""
    counts = training.select("text").mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = stage(counts, "words")
    total = counts.agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("words")).first()
    tokens = total["tokens"] or 0
    frequent = counts.where(F.col("n") >= F.lit(context_share * tokens)).collect() if tokens else []
    unstage(counts)
    found = sorted((int(np.int64(r["word"]).view(np.uint64)), r["n"]) for r in frequent)
    contexts = np.array([w for w, _ in found], np.uint64)
    is_hot = np.array([False] + [n >= hot_share * tokens for _, n in found])
    hot = np.where(is_hot, np.cumsum(is_hot) - 1, -1).astype(np.int32)
    counts = np.array([0] + [n for _, n in found], np.int64)
    return Vocabulary(tokens, total["words"], contexts, hot, counts[is_hot])


# Seating.


@dataclass
class Totals:
    """Customers and tables of the contexts' restaurants (0 unused) and of their parent; discounts of both."""

    customers: np.ndarray
    tables: np.ndarray
    root_customers: float
    root_tables: float
    discount: float
    root_discount: float
    unknown: float  # share of the unknown word in the base measure
    each: float  # share of every known word

    def backoff(self) -> np.ndarray:
        """The share of each context that goes to its parent; all of it for words without a restaurant."""
        share = (STRENGTH + self.discount * self.tables) / (STRENGTH + self.customers)
        share[0] = 1.0
        return share

    def root_mass(self) -> float:
        return STRENGTH + self.root_discount * self.root_tables

    def unknown_probability(self) -> float:
        return self.root_mass() / (STRENGTH + self.root_customers) * self.unknown


def stirling(discount: float, most: int) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t), by S(c+1, t) = S(c, t-1) + (c - t d) S(c, t)."""
    table = np.full((most + 1, most + 1), -np.inf)
    table[1, 1] = 0.0
    for c in range(1, most):
        t = np.arange(1, c + 2)
        grow = np.where(t <= c, np.log(np.maximum(c - t * discount, 1e-300)), -np.inf)
        table[c + 1, t] = np.logaddexp(table[c, t - 1], table[c, t] + grow)
    return table


def draw_tables(customers: np.ndarray, pull: np.ndarray, discount: float, rng: np.random.Generator, logs: np.ndarray) -> np.ndarray:
    """The number of tables of each dish, given its customers (> 0) and ``pull``, the mass of a new table serving it.

    Up to ``_SMALL`` customers by P(t) ~ S(c, t) pull^t; later customers are seated one after another by the Chinese-restaurant
    rule, in runs of a tenth of those seated, within which the rule's rates are held.
    """
    tables = np.ones(len(customers), np.int64)
    first = np.minimum(customers, _SMALL)
    order = np.argsort(first, kind="stable")
    bounds = np.searchsorted(first[order], np.arange(2, _SMALL + 2))
    for c in range(2, _SMALL + 1):
        who = order[bounds[c - 2] : bounds[c - 1]]
        if len(who):
            t = np.arange(1, c + 1)
            weight = logs[c, 1 : c + 1] + t * np.log(pull[who])[:, None]
            total = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), axis=1)
            tables[who] = 1 + (rng.random(len(who))[:, None] * total[:, -1:] > total).sum(1)
    late = np.flatnonzero(customers > _SMALL)
    if len(late):
        seated, wanted, t, mass = _SMALL, customers[late], tables[late].astype(float), pull[late]
        while (wanted > seated).any():
            run = max(1, seated // 10)
            coming = np.clip(wanted - seated, 0, run)
            t = t + rng.binomial(coming, np.clip(mass / (mass + seated - discount * t), 0, 1))
            seated += run
        tables[late] = t
    return tables


def seat(
    words: int, word: np.ndarray, context: np.ndarray, customers: np.ndarray, totals: Totals, sweeps: int, burn: int, seed
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gibbs sweeps over the pairs (word, context) with ``customers`` > 0 of ``words`` words.

    Returns means over the sweeps after the first ``burn``: the pairs' tables, the words' customers in the parent
    restaurant and their tables there.
    """
    rng = np.random.default_rng(seed)
    inner = np.flatnonzero(context > 0)
    several = np.flatnonzero(customers[inner] > 1)  # one customer has one table
    direct = np.bincount(word[context == 0], customers[context == 0], words)
    logs, root_logs = stirling(totals.discount, _SMALL), stirling(totals.root_discount, _SMALL)
    mass, norm = totals.root_mass(), STRENGTH + totals.root_customers
    inner_word, drawn, drawn_word = word[inner], customers[inner][several], word[inner][several]
    inner_mass = STRENGTH + totals.discount * totals.tables[context[inner]][several]
    tables = np.ones(len(inner), np.int64)
    mean_tables, mean_root, mean_root_tables = np.zeros(len(word)), np.zeros(words), np.zeros(words)
    for sweep in range(sweeps):
        at_root = np.round(direct + np.bincount(inner_word, tables, words)).astype(np.int64)
        root_tables = np.zeros(words, np.int64)
        there = at_root > 0
        pull = np.full(int(there.sum()), max(mass * totals.each, 1e-300))
        root_tables[there] = draw_tables(at_root[there], pull, totals.root_discount, rng, root_logs)
        probability = (at_root - totals.root_discount * root_tables + mass * totals.each) / norm
        if len(several):
            tables[several] = draw_tables(drawn, inner_mass * probability[drawn_word], totals.discount, rng, logs)
        if sweep >= burn:
            mean_tables[inner] += tables
            mean_root += at_root
            mean_root_tables += root_tables
    kept = max(1, sweeps - burn)
    return mean_tables / kept, mean_root / kept, mean_root_tables / kept


# Chunks of documents and parts of words.

_PACKED = "kind int, chunk long, part int, blob binary"
_COMPILED = "chunk long, part int, pairs binary, postings binary, kind int"
_DOCS, _HOT, _TAIL, _SUMS = 0, 1, 2, 3


def _pack_chunks(batches: Iterator[pa.RecordBatch], vocab: Vocabulary, part_bits: int) -> Iterator[pa.RecordBatch]:
    number = 0
    for piece in _gathered(batches, CHUNK_BYTES):
        chunk = (TaskContext.get().partitionId() << 32) + number
        number += 1
        rows: list[tuple[int, int, bytes]] = []
        hashes, doc = tokens_of(piece["text"].to_pylist())
        held = piece["held_out"].to_numpy().astype(bool)
        ids = piece["doc_id"]
        known_id = ids.is_valid().to_numpy().astype(bool)
        rows.append((_DOCS, -1, pack(ids.fill_null(0).to_numpy(), known_id, held, np.bincount(doc, minlength=len(held)))))
        own = vocab.ids(hashes)
        before = np.concatenate([np.array([END]), hashes[:-1]])
        context = np.concatenate([vocab.ids(before[:1]), own[:-1]])
        hot = vocab.hot[own]
        is_hot = (hot >= 0) & (context > 0)
        # Runs of equal (document, hot word, context).
        key = (doc[is_hot].astype(np.uint64) << np.uint64(32)) | (hot[is_hot].astype(np.uint64) << np.uint64(16)) | context[is_hot]
        key, times = np.unique(key, return_counts=True)
        rows.append((_HOT, -1, pack(
            (key >> np.uint64(32)).astype(np.uint32), (key >> np.uint64(16)).astype(np.uint16), key.astype(np.uint16),
            times.astype(np.uint32), held,
        )))
        tail = ~is_hot
        place = (vocab.keys(before, context)[tail] << np.uint64(16)) | doc[tail].astype(np.uint64)
        word, of_hot = hashes[tail], hot[tail]
        other, split = np.flatnonzero(of_hot < 0), np.flatnonzero(of_hot >= 0)
        rows += _tail_rows(_part_of(word[other], part_bits), word[other], place[other], held)
        # Hot words by their contexts: the part follows from the key's bits below the flag.
        place = place[split]
        part = (1 << part_bits) + _part_of(place << np.uint64(48 - KEY_BITS), part_bits)
        rows += _tail_rows(part, of_hot[split].astype(np.uint64), place, held)
        for at in range(0, len(rows), 64):
            kinds, parts, blobs = zip(*rows[at : at + 64])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(kinds, pa.int32()),
                    pa.array([chunk] * len(kinds), pa.int64()),
                    pa.array(parts, pa.int32()),
                    pa.array(blobs, pa.binary()),
                ],
                names=["kind", "chunk", "part", "blob"],
            )


def _tail_rows(part: np.ndarray, word: np.ndarray, place: np.ndarray, held: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Packed runs of equal (part, word, place), one value for each part; ``place`` is context and document."""
    order = np.lexsort((place, word, part))
    part, word, place = part[order], word[order], place[order]
    new = np.ones(len(word), bool)
    new[1:] = (word[1:] != word[:-1]) | (place[1:] != place[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(word))).astype(np.uint32)
    part, word, place = part[at], word[at], place[at]
    begins = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
    rows = []
    for begin, end in zip(begins, [*begins[1:], len(part)]):
        mine = slice(begin, end)
        distinct, first = np.unique(word[mine], return_index=True)
        length = np.diff(np.append(first, end - begin)).astype(np.uint32)
        arrays = distinct, length, _planes(place[mine] >> np.uint64(16)), place[mine].astype(np.uint16), times[mine], held
        rows.append((_TAIL, int(part[begin]), pack(*arrays)))
    return rows


def _part_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _planes(values: np.ndarray) -> np.ndarray:
    """All lowest bytes, then all second ones, and so on: planes of few values take no room when compressed."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T.ravel()


def _of_planes(planes: np.ndarray) -> np.ndarray:
    return planes.reshape(8, -1).T.copy().view("<u8").ravel()


def _steps(keys: np.ndarray) -> np.ndarray:
    """Ascending keys by what each adds to the one before."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _of_steps(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(_of_planes(planes), dtype=np.uint64)


def _compile_part(frame: pd.DataFrame, contexts: int, part_bits: int) -> pd.DataFrame:
    """All chunks' postings of a part: its distinct pairs with their training counts, and the postings by pair.

    Words are numbered within the part, hot ones as everywhere; contexts without a number get numbers from ``contexts`` on within it,
    in order of their keys, which are kept.
    """
    words, keys, docs, times, chunk_of, training = [], [], [], [], [], []
    frame = frame.sort_values("chunk", kind="stable")
    part, chunks = int(frame["part"].iloc[0]), frame["chunk"].to_numpy(np.int64)
    for number, blob in enumerate(frame["blob"]):
        word, length, key, doc, n, held = unpack(blob)
        words.append(np.repeat(word, length))
        keys.append(_of_planes(key))
        docs.append(doc)
        times.append(n)
        chunk_of.append(np.full(len(doc), number, np.uint32))
        training.append(~held[doc])
    word, key, doc, n, chunk_no, train = (np.concatenate(x) for x in (words, keys, docs, times, chunk_of, training))
    order = np.lexsort((key, word))
    word, key = word[order], key[order]
    new_word = np.ones(len(word), bool)
    new_word[1:] = word[1:] != word[:-1]
    new = new_word.copy()
    new[1:] |= key[1:] != key[:-1]
    pair = np.cumsum(new) - 1
    customers = np.bincount(pair, n[order] * train[order], int(new.sum())).astype(np.int64)
    key, number = key[new], (word if part >> part_bits else np.cumsum(new_word) - 1)[new]
    rare = key >= _RARE
    own, local = np.unique(key[rare], return_inverse=True)
    context = np.where(rare, 0, key)
    context[rare] = local + contexts
    pairs = pack(_steps(number.astype(np.uint64)), _planes(context), customers, _steps(own))
    length = np.diff(np.append(np.flatnonzero(new), len(word))).astype(np.uint32)
    postings = pack(length, chunk_no[order].astype(np.uint32), doc[order], n[order], chunks)
    return pd.DataFrame({"part": [part], "pairs": [pairs], "postings": [postings]})


def _compiled(frame: pd.DataFrame, contexts: int, part_bits: int) -> pd.DataFrame:
    """A part of the postings compiled; a chunk's own value as it is, in the place of the pairs."""
    kind = int(frame["kind"].iloc[0])
    if kind == _TAIL:
        return _compile_part(frame, contexts, part_bits).assign(chunk=-1, kind=kind)[["chunk", "part", "pairs", "postings", "kind"]]
    return frame.assign(pairs=frame["blob"], postings=None)[["chunk", "part", "pairs", "postings", "kind"]]


@dataclass
class Pairs:
    """The distinct pairs of a part, and the keys of its contexts without a number."""

    words: int
    word: np.ndarray
    context: np.ndarray
    customers: np.ndarray
    keys: np.ndarray

    @classmethod
    def of(cls, blob: bytes) -> Pairs:
        word, context, customers, keys = unpack(blob)
        word, context = _of_steps(word).astype(np.int64), _of_planes(context).astype(np.int64)
        return cls(int(word[-1]) + 1 if len(word) else 0, word, context, customers, _of_steps(keys))

    def columns(self) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        return self.words, self.word, self.context, self.customers


def _statistics(words, word, context, customers, contexts: int) -> np.ndarray:
    """Customers and distinct words of each context, and at the end: pairs and words with one and two customers, the words'
    customers at the parent if each pair has one table, and how many words there are."""
    live = customers > 0
    inner = live & (context > 0)
    at_root = np.bincount(word[live], np.where(context[live] > 0, 1, customers[live]), words)
    tail = [
        (customers[inner] == 1).sum(), (customers[inner] == 2).sum(), (at_root == 1).sum(), (at_root == 2).sum(),
        at_root.sum(), (at_root > 0).sum(),
    ]
    by_context = np.bincount(context[inner], customers[inner], contexts), np.bincount(context[inner], minlength=contexts)
    return np.concatenate([*by_context, tail]).astype(float)


def _seated(words, word, context, customers, totals: Totals, contexts: int, plan: tuple, seed) -> tuple[np.ndarray, tuple]:
    """Tables of each context and customers and tables of the parent after the sweeps, and the means they sum up."""
    live = customers > 0
    tables = np.zeros(len(word))
    tables[live], at_root, root_tables = seat(words, word[live], context[live], customers[live], totals, *plan, seed)
    by_context = np.bincount(context, np.where(context > 0, tables, 0), contexts)
    return np.concatenate([by_context, [at_root.sum(), root_tables.sum()]]), (tables, at_root, root_tables)


def _root(totals: Totals, means: tuple) -> np.ndarray:
    """Each word's probability in the parent restaurant."""
    _, at_root, root_tables = means
    seated = at_root - totals.root_discount * root_tables
    return (seated + totals.root_mass() * totals.each) / (STRENGTH + totals.root_customers)


def _probabilities(words, word, context, customers, totals: Totals, means: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The predictive probability of each pair, and each word's training tokens. ``totals`` are the sums of ``means``, so the
    probabilities of all words in a context, with the unknown one, make 1."""
    count = np.bincount(word, customers, words)
    parent = np.where(count > 0, _root(totals, means), totals.unknown_probability())[word]
    return _predictive(context, customers, totals, means[0], parent), count


def _predictive(context, customers, totals: Totals, tables: np.ndarray, parent: np.ndarray) -> np.ndarray:
    own = np.where(context > 0, (customers - totals.discount * tables) / (STRENGTH + totals.customers[context]), 0.0)
    return np.maximum(own, 0) + totals.backoff()[context] * parent


# Rows that parts send: sums for everybody (at, value), their own sums by context to a context part, and what they drew.
_SENT = "kind int, target int, part int, blob binary, at long, value double"
_TOTAL, _MESSAGE, _DRAWN = 0, 1, 2


def _sent(kind: int, targets: list[int], part: int, blobs: list[bytes]) -> pa.RecordBatch:
    n = len(blobs)
    arrays = [
        pa.array([kind] * n, pa.int32()), pa.array(targets, pa.int32()), pa.array([part] * n, pa.int32()),
        pa.array(blobs, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(arrays, names=["kind", "target", "part", "blob", "at", "value"])


def _messages(part: int, keys: np.ndarray, values: list[np.ndarray], target_bits: int) -> Iterator[pa.RecordBatch]:
    """A part's sums by context, cut by context part."""
    target = _part_of(keys << np.uint64(64 - KEY_BITS), target_bits)
    bounds = np.searchsorted(target, np.arange((1 << target_bits) + 1))
    targets = np.flatnonzero(np.diff(bounds)).tolist()
    cuts = [slice(bounds[t], bounds[t + 1]) for t in targets]
    if targets:
        yield _sent(_MESSAGE, targets, part, [pack(_steps(keys[c]), *(v[c] for v in values)) for c in cuts])


def _answer(frame: pd.DataFrame) -> pd.DataFrame:
    """The totals of the contexts of a context part, for each part those that it holds, in the order it sent them."""
    received = [unpack(blob) for blob in frame["blob"]]
    keys = [_of_steps(r[0]) for r in received]
    ends = np.cumsum([len(k) for k in keys])
    _, number = np.unique(np.concatenate(keys), return_inverse=True)
    values = [np.concatenate(column) for column in zip(*(r[1:] for r in received))]
    totals = [np.bincount(number, value)[number] for value in values]
    cuts = [slice(end - len(k), end) for k, end in zip(keys, ends)]
    blobs = [pack(*(t[cut] for t in totals)) for cut in cuts]
    return pd.DataFrame({"part": frame["part"], "target": frame["target"], "blob": blobs})


def _with_answers(parts: DataFrame, sent: DataFrame) -> DataFrame:
    """Parts with ``answers``: what the context parts make of the messages, in order of the contexts."""
    messages = sent.where(F.col("kind") == _MESSAGE).select("target", "part", "blob")
    answers = messages.groupBy("target").applyInPandas(_answer, "part int, target int, blob binary")
    of_part = answers.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("target", "blob"))).alias("answers"))
    return parts.join(of_part.select("part", F.col("answers.blob").alias("answers")), "part", "left")


def _local(totals: Totals, answers: list[bytes] | None) -> Totals:
    """Totals with those of a part's contexts behind those of the numbered ones."""
    received = [unpack(blob) for blob in answers or []]
    own = [np.concatenate([np.empty(0), *(r[i] for r in received)]) for i in (0, 1)]
    return replace(
        totals, customers=np.concatenate([totals.customers, own[0]]), tables=np.concatenate([totals.tables, own[1]])
    )


def _free_shuffles(spark: SparkSession) -> None:
    """Spark deletes a finished job's shuffle files once the driver's JVM has collected the plan; jobs here are few and large, so it
    is asked to do so after each."""
    spark._jvm.System.gc()


def _values(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Rows one at a time; None for a column that is not there."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(batch[c][i].as_py() if c in batch.schema.names else None for c in columns)


def _round(parts: DataFrame, function, length: int, target_bits: int, name: str) -> tuple[np.ndarray, DataFrame]:
    """``function(part, pairs, answers)`` of all parts, which gives a vector of ``length`` sums, values by the part's own
    contexts, and arrays to keep: the sums of the vectors, and the rows sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for part, blob, answers in _values(batches, "part", "pairs", "answers"):
            pairs = Pairs.of(blob)
            sums, values, drawn = function(part, pairs, answers)
            total += sums
            yield from _messages(part, pairs.keys, values, target_bits)
            if drawn:
                yield _sent(_DRAWN, [-1], part, [pack(*drawn)])
        at = np.flatnonzero(total)
        n = len(at)
        arrays = [
            pa.array([_TOTAL] * n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()),
            pa.array(at), pa.array(total[at]),
        ]
        yield pa.RecordBatch.from_arrays(arrays, names=["kind", "target", "part", "blob", "at", "value"])

    sent = stage(parts.mapInArrow(run, _SENT), name)
    _free_shuffles(parts.sparkSession)
    out = np.zeros(length)
    rows = sent.where(F.col("kind") == _TOTAL).groupBy("at").agg(F.sum("value").alias("value"))
    for r in rows.collect():  # at most one row per numbered context and hot word and a few more
        out[r["at"]] = r["value"]
    return out, sent


def _seat_hot(pairs: Pairs, totals: Totals, probability: np.ndarray, plan: tuple, seed) -> np.ndarray:
    """Mean tables of pairs whose words' probabilities in the parent are given."""
    sweeps, burn = plan
    rng = np.random.default_rng(seed)
    tables = (pairs.customers > 0).astype(float)
    several = np.flatnonzero(pairs.customers > 1)
    if len(several):
        pull = (STRENGTH + totals.discount * totals.tables[pairs.context[several]]) * probability[pairs.word[several]]
        draws, logs = max(1, sweeps - burn), stirling(totals.discount, _SMALL)
        drawn = [draw_tables(pairs.customers[several], pull, totals.discount, rng, logs) for _ in range(draws)]
        tables[several] = sum(drawn) / draws
    return tables


class _Sums:
    """Sums per document of the chunks met, given out when they have become many."""

    def __init__(self, most: int = 1 << 20):
        self.most, self.kept = most, {}

    def add(self, chunk: int, doc: np.ndarray, score: np.ndarray, base: np.ndarray, known: np.ndarray) -> None:
        docs = int(doc.max()) + 1 if len(doc) else 0
        values = np.stack([np.bincount(doc, x, docs) for x in (score, base, known)]) if docs else np.zeros((3, 0))
        old = self.kept.get(chunk)
        if old is not None and old.shape[1] >= docs:
            old[:, :docs] += values
        else:
            if old is not None:
                values[:, : old.shape[1]] += old
            self.kept[chunk] = values

    def full(self) -> bool:
        return sum(x.shape[1] for x in self.kept.values()) > self.most

    def give(self) -> Iterator[pa.RecordBatch]:
        for chunk, values in self.kept.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([_SUMS], pa.int32()), pa.array([chunk], pa.int64()), pa.array([pack(*values)], pa.binary())],
                names=["kind", "chunk", "blob"],
            )
        self.kept = {}


def score_documents(
    documents: DataFrame,
    held_out: Column,
    context_share: float = CONTEXT_SHARE,
    hot_share: float = HOT_SHARE,
    rounds: int = 2,
    sweeps: int = 8,
    burn: int = 3,
    part_tokens: int = PART_TOKENS,
) -> DataFrame:
    """Score all rows (doc_id, text), learning from those that are not ``held_out`` (null counts as held out): doc_id, held_out, n_tokens,
    n_known, train_tokens, base_score, score.

    Tokens: A-Z lower-cased, maximal runs without ASCII white space, and one end for each text (null: empty), which is a token.
    ``base_score`` sums log10((c + 0.1) / (N + 0.1 (V + 1))) over them, ``score`` the log10 of the model's probabilities. All
    unknown words are one. Every row gets a row, repeated ones and those without an id too. Without training rows every token
    is unknown. Other columns are not read.
    """
    if min(context_share, hot_share) < 2**-15 or hot_share < context_share:
        raise ValueError("shares below 2**-15, or hot words that are no contexts")
    spark = documents.sparkSession
    marked = documents.select("doc_id", "text", F.coalesce(held_out, F.lit(True)).alias("held_out"))
    vocab = vocabulary(marked.where("NOT held_out"), context_share, hot_share)
    _free_shuffles(spark)
    contexts = len(vocab.contexts) + 1
    part_bits = max(0, (max(1, -(-vocab.tokens // part_tokens)) - 1).bit_length())
    shared = spark.sparkContext.broadcast(vocab)

    folder = scratch_path(spark, "parts")
    packed = marked.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(
        lambda it: _pack_chunks(it, shared.value, part_bits), _PACKED
    )
    # Postings go to their parts without being written first; what belongs to a chunk goes along as a group of its own.
    group = F.when(F.col("kind") == _TAIL, F.lit(-1)).otherwise(F.col("chunk"))
    compiled = packed.groupBy("kind", "part", group.alias("chunks")).applyInPandas(
        lambda frame: _compiled(frame, contexts, part_bits), _COMPILED
    )
    compiled.write.partitionBy("kind").parquet(folder)
    compiled = spark.read.schema(_COMPILED).parquet(folder)
    _free_shuffles(spark)
    of_kind = {k: compiled.where(F.col("kind") == k).withColumnRenamed("pairs", "blob") for k in (_DOCS, _HOT)}
    parts = compiled.where(F.col("kind") == _TAIL).select("part", "pairs", "postings")

    hot_words, plan, target_bits = len(vocab.hot_counts), (sweeps, burn), max(0, part_bits - 3)
    hot = _hot_pairs(of_kind[_HOT], hot_words, contexts)

    def count(part: int, pairs: Pairs, answers) -> tuple:
        every = contexts + len(pairs.keys)
        sums = _statistics(*pairs.columns(), every)
        customers, tables, rest = sums[:every], sums[every : 2 * every], sums[2 * every :]
        at_root = np.zeros(hot_words)
        if part >> part_bits:
            at_root += np.bincount(pairs.word, pairs.customers > 0, hot_words)
            rest[2:] = 0  # only those who know all of a word's pairs
        vector = np.concatenate([customers[:contexts], tables[:contexts], rest, at_root])
        return vector, [customers[contexts:], tables[contexts:]], None

    narrow = parts.select("part", "pairs")
    stats, sent = _round(narrow, count, 2 * contexts + 6 + hot_words, target_bits, "counted")
    elsewhere = stats[2 * contexts + 6 :]  # customers that hot words have in the parent from pairs in parts
    at_hot = _statistics(*_and_elsewhere(hot, elsewhere), contexts)
    stats = stats[: 2 * contexts + 6] + at_hot
    ones, twos, root_ones, root_twos, root_customers, words = stats[-6:]
    totals = Totals(
        stats[:contexts], stats[contexts : 2 * contexts], root_customers, words,
        _discount(ones, twos), _discount(root_ones, root_twos),
        0.5 if vocab.words else 1.0, 0.5 / max(1, vocab.words),
    )
    at_root = np.bincount(hot[1], minlength=hot_words) + elsewhere
    hot_root = _root(totals, (None, at_root, np.minimum(at_root, 1)))
    for n in range(1, rounds + 1):
        before, probability = totals, hot_root

        def draw(part: int, pairs: Pairs, answers) -> tuple:
            every, local = contexts + len(pairs.keys), _local(before, answers)
            if part >> part_bits:
                tables = _seat_hot(pairs, local, probability, plan, [n, part])
                sums = np.concatenate([np.bincount(pairs.context, tables, every), [0.0, 0.0]])
                at_root, drawn = np.bincount(pairs.word, tables, hot_words), (tables,)
            else:
                sums, drawn = _seated(*pairs.columns(), local, every, plan, [n, part])
                at_root = np.zeros(hot_words)
            customers = np.bincount(pairs.context, pairs.customers, every)
            vector = np.concatenate([sums[:contexts], sums[-2:], at_root])
            return vector, [customers[contexts:], sums[contexts:every]], drawn if n == rounds else None

        hot_sums, hot_means = _seated(*_and_elsewhere(hot, elsewhere), before, contexts, plan, [n, 1 << 31])
        sums, drawn = _round(_with_answers(narrow, sent), draw, contexts + 2 + hot_words, target_bits, "drawn")
        unstage(sent)
        sent, elsewhere = drawn, sums[contexts + 2 :]
        sums = sums[: contexts + 2] + hot_sums
        totals = replace(totals, tables=sums[:contexts], root_customers=sums[-2], root_tables=sums[-1])
        hot_root = _root(totals, hot_means)
    # Scoring takes the averages of the last round under the totals that came of it.
    norm = vocab.tokens + 0.1 * (vocab.words + 1)
    hot_base = np.log10((vocab.hot_counts + 0.1) / norm)
    table = spark.sparkContext.broadcast((_hot_table(hot, hot_means[0], totals, contexts, hot_root), hot_base))

    def score_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, base = table.value
        sums = _Sums()
        for batch in batches:
            for chunk, blob in zip(batch["chunk"].to_pylist(), batch["blob"]):
                doc, word, context, n, _ = unpack(blob.as_py())
                word, context = word.astype(np.int64), context.astype(np.int64)
                sums.add(chunk, doc, n * model[word * contexts + context], n * base[word], n)
            if sums.full():
                yield from sums.give()
        yield from sums.give()

    def score_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for part, pairs, postings, drawn, answers in _values(batches, "part", "pairs", "postings", "blob", "answers"):
            distinct, local, means = Pairs.of(pairs), _local(totals, answers), unpack(drawn)
            word = distinct.word
            if part >> part_bits:
                probability = _predictive(distinct.context, distinct.customers, local, means[0], hot_root[word])
                base, known = hot_base[word], np.ones(len(word), bool)
            else:
                probability, count = _probabilities(*distinct.columns(), local, means)
                base, known = np.log10((count + 0.1) / norm)[word], (count > 0)[word]
            model = np.log10(probability)
            length, chunk_no, doc, n, chunks = unpack(postings)
            pair = np.repeat(np.arange(len(length)), length)
            order = np.argsort(chunk_no, kind="stable")
            bounds = np.searchsorted(chunk_no[order], np.arange(len(chunks) + 1))
            for i, chunk in enumerate(chunks.tolist()):
                mine = order[bounds[i] : bounds[i + 1]]
                which, times = pair[mine], n[mine]
                sums.add(chunk, doc[mine], times * model[which], times * base[which], times * known[which])
            if sums.full():
                yield from sums.give()
        yield from sums.give()

    last = stage(_with_answers(sent.where(F.col("kind") == _DRAWN).select("part", "blob"), sent), "last")
    unstage(sent)
    _free_shuffles(spark)
    schema = "kind int, chunk long, blob binary"
    rows = (
        of_kind[_DOCS].select("kind", "chunk", "blob")
        .unionByName(of_kind[_HOT].select("chunk", "blob").mapInArrow(score_hot, schema))
        .unionByName(parts.join(last, "part").mapInArrow(score_parts, schema))
    )
    result = rows.groupBy("chunk").applyInPandas(
        _finish, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return result.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(vocab.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


def _discount(ones: float, twos: float) -> float:
    """Share of the pairs seen once, by the usual estimate, kept off the ends."""
    return float(np.clip(ones / (ones + 2 * twos), 0.05, 0.95)) if ones else 0.5


def _hot_pairs(chunks: DataFrame, words: int, contexts: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Training counts of the hot words by context: at most (1 / hot_share) * (1 / context_share) pairs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(words * contexts, np.int64)
        for batch in batches:
            for blob in batch["blob"]:
                doc, word, context, n, held = unpack(blob.as_py())
                train = ~held[doc]
                at = word[train].astype(np.int64) * contexts + context[train]
                total += np.bincount(at, n[train], len(total)).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    if not words:
        return 0, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    table = chunks.select("blob").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    at, n = table["at"].to_numpy(), table["n"].to_numpy()
    order = np.argsort(at)
    return words, at[order] // contexts, at[order] % contexts, n[order]


def _and_elsewhere(hot: tuple, customers: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of hot words, and as pairs without a context what each has in the parent from pairs elsewhere."""
    words, word, context, n = hot
    more = np.round(customers).astype(np.int64)
    return (
        words, np.concatenate([word, np.arange(words)]), np.concatenate([context, np.zeros(words, np.int64)]),
        np.concatenate([n, more]),
    )


def _hot_table(hot: tuple, tables: np.ndarray, totals: Totals, contexts: int, root: np.ndarray) -> np.ndarray:
    """log10 of the model for every (hot word, numbered context)."""
    words, word, context, customers = hot
    dense = totals.backoff()[None, :] * root[:, None]  # where the context has not seen the word
    dense[word, context] = _predictive(context, customers, totals, tables[: len(word)], root[word])
    return np.log10(dense).ravel()


def _finish(frame: pd.DataFrame) -> pd.DataFrame:
    kinds = frame["kind"].to_numpy()
    ids, known_id, held, n_tokens = unpack(frame["blob"].iloc[int(np.flatnonzero(kinds == _DOCS)[0])])
    total = np.zeros((3, len(ids)))
    for row in np.flatnonzero(kinds == _SUMS):
        values = unpack(frame["blob"].iloc[int(row)])
        for line, value in zip(total, values):
            line[: len(value)] += value
    doc_id = pd.array(ids, "Int64")
    doc_id[~known_id] = pd.NA
    return pd.DataFrame(
        {
            "doc_id": doc_id,
            "held_out": held,
            "n_tokens": n_tokens,
            "n_known": total[2].round().astype(np.int64),
            "base_score": total[1],
            "score": total[0],
        }
    )
