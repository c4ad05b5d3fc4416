"""Hard negatives from a forest of cover trees over norm-augmented vectors.

An inner product becomes a distance by one more coordinate: with M the greatest length in a tree, x' = (x, sqrt(M^2 - |x|^2)) lies on
the sphere of radius M, and a query q' = (q, 0) has q'.x' = q.x = |q| M cos(angle). A node covers its points within an angle
rho of its centre, so all their products lie between |q| M cos(theta + rho) and |q| M cos(theta - rho), theta being the
angle to the centre.

Levels halve (or shrink by ``SHRINK``) the covering radius: a node's children have centres that are farther apart than the next radius, each
point goes to the nearest of them, and the first child keeps its parent's centre. The radius stored is the one found, which is no
larger. A search takes nodes best bound first; a node goes to those queries whose window of scores [lo, hi] and k-th best
score it may still meet, and what reaches a leaf is verified by exact integer products.

A tree holds at most ``rows_per_tree`` vectors of one label and of much the same length. Trees are built once, stored, and searched
by tasks that hold a block of queries of bounded size; a task sends the k best of each query, never all pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bagtree.llm.products import products
from bagtree.sources.scratch import stage, unstage

# What a level divides the covering radius by, how many points need no further split, and the slack of bounds in doubles.
SHRINK = 1.4
LEAF = 48
_SLACK = 1e-6
_LONG = np.iinfo(np.int64)

_TREE = (
    "label long, ids array<long>, vecs array<long>, dim int, longest double, centre array<int>, angle array<double>, "
    "child array<int>, children array<int>, start array<int>, stop array<int>"
)
_FOUND = "query_id long, window long, vec_id long, score long"


class CoverTree:
    """``centre`` and ``angle`` of every node, its children (``child``, ``children``: first and number) and the points below it
    (``start`` to ``stop`` in ``ids`` and ``vectors``, which are in the order of the leaves)."""

    def __init__(self, ids, vectors, longest, centre, angle, child, children, start, stop):
        self.ids, self.vectors, self.longest = ids, vectors, longest
        self.centre, self.angle, self.child, self.children, self.start, self.stop = centre, angle, child, children, start, stop

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF, shrink: float = SHRINK) -> CoverTree:
        x = vectors.astype(np.float64)
        norms = np.einsum("nd,nd->n", x, x)
        longest = float(np.sqrt(norms.max(initial=0.0)))
        x = np.column_stack([x, np.sqrt(np.maximum(longest**2 - norms, 0.0))])
        order = np.arange(len(ids))
        away = _distance(x, x[0])
        # One entry per node: centre (a row), radius, first child, children, start and stop in ``order``.
        nodes = [[0, float(away.max(initial=0.0)), -1, 0, 0, len(ids)]]
        level = [(0, away)]
        while level:
            deeper = []
            for node, away in level:
                centre, radius, _, _, start, stop = nodes[node]
                if stop - start <= leaf or radius <= 0:
                    continue
                rows = order[start:stop].copy()
                owner, near, centres = _cover(x[rows], int(np.flatnonzero(rows == centre)[0]), away, radius / shrink)
                by = np.argsort(owner, kind="stable")
                order[start:stop], near = rows[by], near[by]
                edges = np.searchsorted(owner[by], np.arange(len(centres) + 1))
                nodes[node][2:4] = [len(nodes), len(centres)]
                for c, a, b in zip(centres, edges[:-1], edges[1:]):
                    deeper.append((len(nodes), near[a:b]))
                    nodes.append([int(rows[c]), float(near[a:b].max(initial=0.0)), -1, 0, start + a, start + b])
            level = deeper
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        centre, radius, child, children, start, stop = (np.array(column) for column in zip(*nodes))
        angle = 2 * np.arcsin(np.minimum(radius / (2 * longest), 1.0)) if longest > 0 else np.zeros(len(nodes))
        return cls(ids[order], vectors[order], longest, place[centre], angle, child, children, start, stop)

    def row(self, label: int) -> pa.RecordBatch:
        dim = self.vectors.shape[1]
        values = [label, self.ids, self.vectors.reshape(-1), dim, self.longest]
        values += [self.centre, self.angle, self.child, self.children, self.start, self.stop]
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.float64(), pa.list_(pa.int32())]
        types += [pa.list_(pa.float64())] + [pa.list_(pa.int32())] * 4
        names = [part.split()[0] for part in _TREE.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)

    @classmethod
    def from_row(cls, batch: pa.RecordBatch, i: int) -> CoverTree:
        part = {name: batch[name][i] for name in batch.schema.names}
        array = lambda name: part[name].values.to_numpy(zero_copy_only=False)
        vectors = array("vecs").reshape(-1, part["dim"].as_py()) if part["dim"].as_py() else np.zeros((len(array("ids")), 0), np.int64)
        return cls(
            array("ids"), vectors, part["longest"].as_py(), *(array(n) for n in ("centre", "angle", "child", "children", "start", "stop"))
        )


def _distance(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Distances by differences: none is lost where points are close."""
    diff = x - point
    return np.sqrt(np.einsum("nd,nd->n", diff, diff))


def _cover(x: np.ndarray, first: int, away: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Centres farther apart than ``radius`` that cover all points within it, farthest point next: (owner, distance, centres)."""
    owner, near, centres = np.zeros(len(x), np.int64), away.copy(), [first]
    while near.max() > radius:
        centre = int(near.argmax())
        distance = _distance(x, x[centre])
        closer = distance < near
        owner[closer], near[closer] = len(centres), distance[closer]
        centres.append(centre)
    return owner, near, centres


class Queries:
    """A block of queries: a window of scores each, their k best distinct ids so far, and the bar a score must reach."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
        self.ids, self.vectors, self.low, self.high, self.k = ids, vectors, low, high, k
        self.norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
        self.best_ids = np.full((len(ids), k), _LONG.max)
        self.best_scores = np.full((len(ids), k), _LONG.min)
        self.found = np.zeros(len(ids), np.int64)
        self.verified = 0

    def bar(self, q: np.ndarray) -> np.ndarray:
        """The k-th best score, or the window's lower end until there are k."""
        return np.where(self.found[q] < self.k, self.low[q], np.maximum(self.best_scores[q, -1], self.low[q]))

    def search(self, tree: CoverTree, q: np.ndarray) -> None:
        """Look through a tree for the queries with the numbers ``q``, best node first."""
        if not len(q) or not len(tree.ids):
            return
        heap: list[tuple[float, int]] = []
        waiting: dict[int, np.ndarray] = {}
        bounds: dict[int, np.ndarray] = {}

        def offer(node: int, q: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
            fits = (upper >= self.bar(q)) & (lower <= self.high[q])
            if fits.any():
                waiting[node], bounds[node] = q[fits], upper[fits]
                heapq.heappush(heap, (-float(upper[fits].max()), node))

        upper, lower = self._bounds(tree, q, np.zeros(1, np.int64))
        offer(0, q, upper[:, 0], lower[:, 0])
        while heap:
            node = heapq.heappop(heap)[1]
            q, upper = waiting.pop(node), bounds.pop(node)
            q = q[upper >= self.bar(q)]  # the bar may have risen since
            if not len(q):
                continue
            if not tree.children[node]:
                self._verify(tree, int(tree.start[node]), int(tree.stop[node]), q)
                continue
            below = np.arange(tree.child[node], tree.child[node] + tree.children[node])
            upper, lower = self._bounds(tree, q, below)
            for i, child in enumerate(below):
                offer(int(child), q, upper[:, i], lower[:, i])

    def _bounds(self, tree: CoverTree, q: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        reach = self.norms[q] * tree.longest
        inner = self.vectors[q].astype(np.float64) @ tree.vectors[tree.centre[nodes]].astype(np.float64).T
        with np.errstate(invalid="ignore", divide="ignore"):
            theta = np.arccos(np.clip(np.nan_to_num(inner / reach[:, None]), -1.0, 1.0))
        rho = tree.angle[nodes][None, :]
        slack = (_SLACK * reach)[:, None] + _SLACK
        upper = reach[:, None] * np.cos(np.maximum(theta - rho, 0.0)) + slack
        return upper, reach[:, None] * np.cos(np.minimum(theta + rho, np.pi)) - slack

    def _verify(self, tree: CoverTree, start: int, stop: int, q: np.ndarray, step: int = 1024) -> None:
        for at in range(0, stop - start, step):
            part = slice(start + at, min(stop, start + at + step))
            ids, scores = tree.ids[part], products(self.vectors[q], tree.vectors[part])
            self.verified += scores.size
            good = (scores >= self.bar(q)[:, None]) & (scores <= self.high[q][:, None]) & (ids[None, :] != self.ids[q][:, None])
            row, col = np.nonzero(good)
            if len(row):
                self._add(q[row], ids[col], scores[row, col])

    def _add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        touched = np.unique(q)
        old_row, old_col = np.nonzero(np.arange(self.k)[None, :] < self.found[touched][:, None])
        q = np.concatenate([touched[old_row], q])
        ids = np.concatenate([self.best_ids[touched][old_row, old_col], ids])
        scores = np.concatenate([self.best_scores[touched][old_row, old_col], scores])
        order = np.lexsort((~scores, ids, q))  # forms of one id together, the best first
        q, ids, scores = q[order], ids[order], scores[order]
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])
        q, ids, scores = q[new], ids[new], scores[new]
        order = np.lexsort((ids, ~scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        keep = rank < self.k
        q, ids, scores, rank = q[keep], ids[keep], scores[keep], rank[keep]
        self.best_ids[q, rank], self.best_scores[q, rank] = ids, scores
        np.maximum.at(self.found, q, rank + 1)

    def results(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, id, score) of all that was found."""
        row, col = np.nonzero(np.arange(self.k)[None, :] < self.found[:, None])
        return row, self.best_ids[row, col], self.best_scores[row, col]


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Integer rows of width ``dim``; shorter vectors end in zeros."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lengths = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), dim), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def forest(vectors: DataFrame, dim: int, rows: int, rows_per_tree: int = 4096) -> DataFrame:
    """Cover trees over (vec_id, label, vec), one row each. Rows are dealt by label, length and id, so a crowded label, or
    any number of copies of one vector, fills as many trees as it needs."""
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    parts = max(1, -(-rows // (4 * rows_per_tree)))
    dealt = vectors.select("label", norm.alias("norm"), "vec_id", "vec").repartitionByRange(parts, "label", "norm", "vec_id")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def trees(label: int) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            for at in range(0, rows.num_rows, rows_per_tree):
                part = rows.slice(at, rows_per_tree)
                yield CoverTree.build(part["vec_id"].to_numpy(), _matrix(part["vec"], dim)).row(label)

        last = None
        for batch in batches:
            labels = batch["label"].to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(labels)) + 1), len(labels)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                if held and (labels[a] != last or sum(x.num_rows for x in held) >= rows_per_tree):
                    yield from trees(int(last))
                held.append(batch.slice(a, b - a))
                last = labels[a]
        if held:
            yield from trees(int(last))

    return dealt.sortWithinPartitions("label", "norm", "vec_id").mapInArrow(build, _TREE)


def _searched(trees: DataFrame, block: tuple, same_label: bool, k: int) -> DataFrame:
    """(query_id, window, vec_id, score): the k best of each (query, window) in each partition of trees.

    ``block``: query ids, labels, vectors, window ids, low and high, one entry per query and window; broadcast, of bounded size.
    """
    shared = trees.sparkSession.sparkContext.broadcast(block)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors, windows, low, high = shared.value
        queries = Queries(ids, vectors, low, high, k)
        for batch in batches:
            for i in range(batch.num_rows):
                own = labels == batch["label"][i].as_py()
                queries.search(CoverTree.from_row(batch, i), np.flatnonzero(own if same_label else ~own))
        row, found, scores = queries.results()
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[row]), pa.array(windows[row]), pa.array(found), pa.array(scores)], names=["query_id", "window", "vec_id", "score"]
        )

    return trees.mapInArrow(search, _FOUND)


def _first_k(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best distinct ids per key, with ``rank``; each has its best form's score."""
    best = found.groupBy(*keys, "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    low: tuple[int, int] = (80, 100),
    rows_per_tree: int = 4096,
    query_block_bytes: int = 8 << 20,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor and positive.

    ``vectors``: vec_id long, label long, vec array<long>; ``is_anchor`` says by vec_id which rows are anchors. An anchor's positives are
    the best ``positives`` other ids of its label by inner product. For each, its negatives are the best ``negatives`` ids of
    other labels whose score s satisfies low * positive_score <= s <= positive_score (``low`` as a fraction), ranked from 1, ties
    to the smaller id. All are given where there are fewer.

    Ids are keys: rows that share one are forms of one vector, each under its own label; the best form counts, and none answers its own
    anchor. Shorter vectors count as if they ended in zeros. Rows with a null id, label or vector take no part; other columns
    are not looked at. Scores beyond a long are cut to it. A negative positive score leaves an empty window. An empty table,
    or one without anchors, gives no rows.
    """
    spark = vectors.sparkSession
    usable = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull())
    usable = usable.select("vec_id", F.col("label").cast("long").alias("label"), "vec")
    shape = usable.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim")).first()
    dim = max(0, shape["dim"] or 0)
    trees = stage(forest(usable, dim, shape["n"], rows_per_tree), "trees")
    anchors = stage(usable.where(is_anchor), "anchors")
    per_block = max(64, query_block_bytes // (8 * max(1, dim) * max(1, positives)))
    blocks = max(1, -(-anchors.count() // per_block))
    answers = None
    for number in range(blocks):
        block = anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number) if blocks > 1 else anchors
        table = block.toArrow()
        ids, labels, matrix = table["vec_id"].to_numpy(), table["label"].to_numpy(), _matrix(table["vec"], dim)
        none, anything = np.full(len(ids), _LONG.min), np.full(len(ids), _LONG.max)
        near = _searched(trees, (ids, labels, matrix, np.zeros(len(ids), np.int64), none, anything), True, positives)
        near = stage(_first_k(near, ["query_id"], positives).select("query_id", "vec_id", "score"), "positives")
        chosen = near.toArrow()  # at most ``positives`` rows per anchor of the block
        of = {}
        for anchor, positive, score in zip(*(chosen[name].to_pylist() for name in ("query_id", "vec_id", "score"))):
            of.setdefault(anchor, []).append((positive, score))
        asks = [(i, positive, -((-low[0] * score) // low[1]), score) for i, a in enumerate(ids) for positive, score in of.get(int(a), ())]
        # A window whose lower end lies above its upper end (a negative score) is empty.
        asks = [ask for ask in asks if ask[2] <= ask[3]]
        at, window, lows, highs = (np.array(x, np.int64) for x in (zip(*asks) if asks else ((), (), (), ())))
        far = _searched(trees, (ids[at], labels[at], matrix[at], window, lows, highs), False, negatives)
        top = _first_k(far, ["query_id", "window"], negatives).select(
            F.col("query_id").alias("anchor_id"),
            F.col("window").alias("positive_id"),
            F.col("rank").cast("int").alias("rank"),
            F.col("vec_id").alias("negative_id"),
            F.col("score").alias("negative_score"),
        )
        scores = near.select(F.col("query_id").alias("anchor_id"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        done = stage(top.join(scores, ["anchor_id", "positive_id"]), "negatives")
        unstage(near)
        answers = done if answers is None else answers.unionByName(done)
    unstage(trees, anchors)
    return answers.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
