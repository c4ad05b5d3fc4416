"""Words and word shingles of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_MULT = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3 * 2 + 1)  # odd, so that it has an inverse modulo 2**64
_CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_bytes() -> np.ndarray:
    """Which bytes belong to words: ASCII letters and digits, and all bytes of other characters."""
    table = np.zeros(256, bool)
    table[128:] = True
    for a, b in (("0", "9"), ("a", "z"), ("A", "Z")):
        table[ord(a) : ord(b) + 1] = True
    return table


_IN_WORD = _word_bytes()
_powers = np.ones(1, np.uint64)


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, 1 << 20), _STEP, np.uint64))])
    return _powers[:n]


class Words:
    """The words of a batch of texts: ``hashes``, ``start`` and ``end`` (bytes in ``data``), and ``first``, the first word of each
    text and the end of the last."""

    def __init__(self, data: np.ndarray, total, start, end, first):
        self.data, self.total, self.start, self.end, self.first = data, total, start, end, first
        self.hashes = self._spans(start, end)

    def _spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        hashes = (self.total[end] - self.total[start]) * _powers_to(len(self.total))[end]
        return mix(hashes ^ ((end - start).astype(np.uint64) * _MULT))

    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, word number) of the first ``size`` bytes of every longer word."""
        longer = np.flatnonzero(self.end - self.start > size)
        begin = self.start[longer]
        return self._spans(begin, begin + size), longer

    def owners(self) -> np.ndarray:
        """The text of each word."""
        count = np.diff(self.first)
        return np.repeat(np.arange(len(count)), count)


def words_of(
    texts: list[str | None], in_word: np.ndarray = _IN_WORD, ascii_case: bool = False, keep_case: bool = False
) -> Words:
    """Words are maximal runs of ``in_word`` bytes of the lower-cased texts (``ascii_case``: only A-Z are; ``keep_case``: nothing
    is); a null text has none.

    Equal words have equal hashes: sum of byte * step**(places to the word's end), modulo 2**64, mixed with the length.
    """
    if keep_case:
        encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    elif ascii_case:
        encoded = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    else:
        encoded = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(encoded) + b" ", np.uint8)
    bounds = np.cumsum([len(e) + 1 for e in encoded])
    inside = in_word[data]
    if len(encoded):
        inside[bounds - 1] = False
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    # Prefix sums of byte * step**-i; step is odd, so it has an inverse modulo 2**64.
    n = len(data)
    inverse = _inverse_powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * inverse, out=total[1:])
    first = np.searchsorted(start, np.concatenate([[0], bounds]))
    return Words(data, total, start, end, first)


_inverse = np.ones(1, np.uint64)


def _inverse_powers(n: int) -> np.ndarray:
    global _inverse
    if len(_inverse) < n:
        step = np.uint64(pow(int(_STEP), -1, 1 << 64))
        _inverse = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, 1 << 20), step, np.uint64))])
    return _inverse[:n]


def shingles_of(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, owner): all runs of ``size`` words of each text; a text of fewer words, but not none, has one of all its words."""
    count = np.diff(words.first)
    number = np.where(count >= size, count - size + 1, (count > 0).astype(count.dtype))
    owner = np.repeat(np.arange(len(count)), number)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
    at = words.first[owner] + place
    length = np.minimum(count, size)[owner]
    some_short = bool((length < size).any())
    hashes = np.zeros(len(owner), np.uint64)
    padded = np.concatenate([words.hashes, np.zeros(size, np.uint64)])
    for i in range(size):
        longer = (hashes + padded[at + i]) * _STEP
        hashes = longer if not some_short else np.where(i < length, longer, hashes)
    return mix(hashes ^ (length.astype(np.uint64) << np.uint64(56))), owner


def counted(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, hash) in that order, and how often each occurs."""
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return hashes[at], owner[at], np.diff(np.append(at, len(hashes)))


def chunks(texts: list[str | None], size: int = _CHUNK) -> Iterator[slice]:
    """Slices of about ``size`` characters, at least one text each, so that arrays stay small whatever the batch holds."""
    begin = total = 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > begin and total + n > size:
            yield slice(begin, i)
            begin, total = i, 0
        total += n
    if begin < len(texts):
        yield slice(begin, len(texts))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that few texts are Python strings at a time. At the end the worker, which stays for
    later tasks, gives free memory back."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)
    release_memory()


def release_memory() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library
