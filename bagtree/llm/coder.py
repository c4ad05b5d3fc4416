"""Adaptive context-mixing range coder for blocks of token ids.

A block's ids are cut into lanes of equal length that are coded in lockstep, one numpy operation for a step of all lanes. They
share one model, which starts empty in each block and learns from every step:

* order 0: counts of the ids, with a floor, as a cumulative table;
* order 1 and 2: for each context the id that followed it last, with a confidence that rises when it is right.

A prediction of order 1 or 2 gets the probability with which predictions of its confidence have been right so far, order 0
shares the rest. So the cumulative probability of any id is a scaled order-0 value plus at most two jumps, and the decoder
inverts it directly. Each lane has a range coder of its own (64-bit low and range, 32-bit output words, no carries).
"""

from __future__ import annotations

import numpy as np

BITS = 21
TOTAL = np.uint64(1 << BITS)
LANE_STEPS = 256
MAX_LANES = 4096
_FLOOR = 4  # of TOTAL, for each id in order 0
_MOST = (1 << BITS) * 3 // 8  # for one prediction, so that order 0 keeps a quarter
_TABLE2 = 1 << 18
_HASH = np.uint64(0x9E3779B97F4A7C15)
_U32 = np.uint64(32)
_LOW32 = np.uint64(0xFFFFFFFF)
_LIMIT = np.uint64(1 << 32)
_LEVELS = 16


# The next confidence, by confidence and hit.
_NEXT = np.array([[c >> 1, min(c + 1, _LEVELS - 1)] for c in range(_LEVELS)], np.int64).ravel()


def _refresh_steps(steps: int) -> set[int]:
    """When the tables are made anew: often at first, then less and less."""
    at, out = 1.0, set()
    while at < steps:
        out.add(int(at))
        at = max(at + 1, at * 1.25)
    return out


class Model:
    def __init__(self, vocab: int):
        if vocab * _FLOOR * 2 > 1 << BITS:
            raise ValueError(f"ids must be below {(1 << BITS) // (_FLOOR * 2)}")
        self.vocab = vocab
        self.counts = np.zeros(vocab, np.int64)
        # Per context: the id that followed last and the confidence in it, as id * 16 + confidence.
        self.order1, self.order2 = np.zeros(vocab + 1, np.int64), np.zeros(_TABLE2, np.int64)
        self.tried = np.ones((2, _LEVELS))
        self.right = np.full((2, _LEVELS), 0.2)
        self.refresh()

    def refresh(self, symbols: bool = False) -> None:
        spare = (1 << BITS) - self.vocab * _FLOOR
        seen = int(self.counts.sum())
        share = self.counts * spare // seen if seen else np.full(self.vocab, spare // self.vocab)
        freq = share + _FLOOR
        freq[0] += (1 << BITS) - int(freq.sum())
        self.cum = np.zeros(self.vocab + 1, np.uint64)
        np.cumsum(freq, out=self.cum[1:], dtype=np.uint64)
        mass = np.minimum(_MOST, self.right / self.tried * (1 << BITS) * 0.95).astype(np.uint64)
        mass[:, 0] = 0
        # For each pair of confidences (order 2, order 1): the masses of both predictions and what is left to order 0.
        self.mass2 = np.repeat(mass[1], _LEVELS)
        self.mass1 = (np.tile(mass[0], _LEVELS) * (TOTAL - self.mass2)) >> np.uint64(BITS)
        if symbols:  # the id of each value, for the decoder
            self.symbols = np.repeat(np.arange(self.vocab, dtype=np.uint16 if self.vocab <= 1 << 16 else np.uint32), freq)

    def context2(self, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        mixed = (last.astype(np.uint64) * np.uint64(self.vocab + 1) + before.astype(np.uint64)) * _HASH
        return (mixed >> np.uint64(64 - 18)).astype(np.int64)

    def predict(self, last: np.ndarray, context2: np.ndarray) -> None:
        """Sets this step's predictions a1, a2, their masses m1, m2, and what is left to order 0."""
        self.last, self.context = last, context2
        entry1, entry2 = self.order1[last], self.order2[context2]
        self.a1, self.a2 = entry1 >> 4, entry2 >> 4
        self.c1, self.c2 = entry1 & 15, entry2 & 15
        both = (self.c2 << 4) | self.c1
        self.m1, self.m2 = self.mass1[both], self.mass2[both]
        self.m1[(self.a1 == self.a2) & (self.c2 > 0)] = 0
        self.rest = TOTAL - self.m1 - self.m2

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first value and the number of values of each id."""
        self.hit1, self.hit2 = self.a1 == ids, self.a2 == ids
        low = (self.cum[ids] * self.rest) >> np.uint64(BITS)
        size = ((self.cum[ids + 1] * self.rest) >> np.uint64(BITS)) - low
        size += self.m1 * self.hit1
        size += self.m2 * self.hit2
        low += self.m1 * (self.a1 < ids)
        low += self.m2 * (self.a2 < ids)
        return low, size

    def find(self, values: np.ndarray) -> np.ndarray:
        """The ids in whose intervals the values lie."""
        shift = np.uint64(BITS)
        # The intervals of both predictions; equal ids have one, with the mass of both.
        first1 = ((self.cum[self.a1] * self.rest) >> shift) + self.m2 * (self.a2 < self.a1)
        first2 = ((self.cum[self.a2] * self.rest) >> shift) + self.m1 * (self.a1 < self.a2)
        end1 = ((self.cum[self.a1 + 1] * self.rest) >> shift) + self.m2 * (self.a2 <= self.a1) + self.m1
        end2 = ((self.cum[self.a2 + 1] * self.rest) >> shift) + self.m1 * (self.a1 <= self.a2) + self.m2
        # Any other id: without the masses below it, the value is one of order 0.
        plain = values - self.m1 * (values >= end1) - self.m2 * (values >= end2)
        at = ((plain + np.uint64(1)) * TOTAL - np.uint64(1)) // self.rest
        ids = self.symbols[np.minimum(at, TOTAL - np.uint64(1)).astype(np.int64)].astype(np.int64)
        ids = np.where((values >= first2) & (values < end2), self.a2, ids)
        return np.where((values >= first1) & (values < end1), self.a1, ids)

    def learn(self, ids: np.ndarray, tally: bool) -> None:
        if tally:
            for row, (sure, hit) in enumerate(((self.c1, self.hit1), (self.c2, self.hit2))):
                self.tried[row] += np.bincount(sure, minlength=_LEVELS)
                self.right[row] += np.bincount(sure[hit], minlength=_LEVELS)
        fresh = (ids << 4) | 1
        for table, at, guess, sure, hit in (
            (self.order1, self.last, self.a1, self.c1, self.hit1),
            (self.order2, self.context, self.a2, self.c2, self.hit2),
        ):
            # A right prediction gains; a wrong one that has often been right keeps its place with half the confidence.
            kept = (guess << 4) | _NEXT[(sure << 1) | hit]
            table[at] = np.where(hit | (sure >= 4), kept, fresh)


def _renormalise(low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """The lanes that must give out a word; cuts the range of those that straddle a boundary with too little left."""
    settled = (low ^ (low + span)) < _LIMIT
    narrow = ~settled & (span < _LIMIT)
    if narrow.any():
        span[narrow] = (np.uint64(0) - low[narrow]) & _LOW32
    return np.flatnonzero(settled | narrow)


def encode_block(ids: np.ndarray, vocab: int) -> tuple[int, np.ndarray, bytes]:
    """(steps, words per lane, payload) of at least one id."""
    n = len(ids)
    if n and int(ids.max()) >= vocab:
        raise ValueError("id beyond the vocabulary")
    lanes = min(MAX_LANES, -(-n // LANE_STEPS))
    steps = -(-n // lanes)
    lanes = -(-n // steps)
    padded = np.zeros(lanes * steps, np.int64)
    padded[:n] = ids
    grid = np.ascontiguousarray(padded.reshape(lanes, steps).T)
    model, refresh = Model(vocab), _refresh_steps(steps)
    start = np.full((1, lanes), vocab, np.int64)
    last = np.concatenate([start, grid[:-1]])
    before = np.concatenate([start, last[:-1]])
    context = model.context2(last, before)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    out, filled = np.zeros((lanes, steps + 2), np.uint32), np.zeros(lanes, np.int64)
    shift = np.uint64(BITS)
    for step in range(steps):
        ids_now = grid[step]
        model.predict(last[step], context[step])
        first, size = model.interval(ids_now)
        unit = span >> shift
        low += unit * first
        span = unit * size
        give = _renormalise(low, span)
        out[give, filled[give]] = low[give] >> _U32
        filled[give] += 1
        low[give] <<= _U32
        span[give] <<= _U32
        model.learn(ids_now, step in refresh)
        if step in refresh:
            model.counts = np.bincount(grid[: step + 1].ravel(), minlength=vocab)
            model.refresh()
    lane = np.arange(lanes)
    for word in (low >> _U32, low & _LOW32):
        out[lane, filled] = word
        filled += 1
    payload = out[np.arange(steps + 2)[None, :] < filled[:, None]]
    return steps, filled.astype(np.uint32), payload.astype("<u4").tobytes()


def decode_block(n: int, steps: int, lane_words: np.ndarray, payload: bytes, vocab: int) -> np.ndarray:
    """The ``n`` ids of a block."""
    words = np.concatenate([np.frombuffer(payload, "<u4"), np.zeros(2, np.uint32)]).astype(np.uint64)
    lanes = len(lane_words)
    at = np.concatenate([[0], np.cumsum(lane_words.astype(np.int64))[:-1]])
    code = (words[at] << _U32) | words[at + 1]
    at = at + 2
    model, refresh = Model(vocab), _refresh_steps(steps)
    model.refresh(symbols=True)
    grid = np.empty((steps, lanes), np.int64)
    last, before = np.full(lanes, vocab, np.int64), np.full(lanes, vocab, np.int64)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    shift = np.uint64(BITS)
    end = len(words) - 1
    for step in range(steps):
        model.predict(last, model.context2(last, before))
        unit = span >> shift
        values = np.minimum((code - low) // unit, TOTAL - np.uint64(1))
        ids = model.find(values)
        first, size = model.interval(ids)
        low += unit * first
        span = unit * size
        take = _renormalise(low, span)
        code[take] = (code[take] << _U32) | words[np.minimum(at[take], end)]
        at[take] += 1
        low[take] <<= _U32
        span[take] <<= _U32
        grid[step] = ids
        model.learn(ids, step in refresh)
        if step in refresh:
            model.counts = np.bincount(grid[: step + 1].ravel(), minlength=vocab)
            model.refresh(symbols=True)
        before, last = last, ids
    return grid.T.ravel()[:n].astype(np.uint32)
