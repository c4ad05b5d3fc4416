"""Arrow kernels for the vector loops that SQL expressions evaluate element by element.

Each kernel works on one Arrow batch with numpy; Spark decides on partitions, shuffles and merges. Kernels that
hold a codebook (or query matrix) get it as a broadcast whose size the caller has checked. Kernels that reduce
keep one entry per node of that codebook and partition, so their memory has the same bound.
"""

from __future__ import annotations

import hashlib
import sys
from typing import Iterator, NamedTuple, Tuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import functions as F

# Ship this module's code with the tasks, so that executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Broadcast values are pickled without the classes of this module: send ``tuple(book)``, read ``Codebook(*value)``.

# Work memory of one block of differences, in bytes.
_BLOCK_BYTES = 1 << 20
_SCORE_BYTES = 64 << 20

# Vectors of (row, query) pairs that are compared at once, in bytes.
_PAIR_BYTES = 8 << 20


class Codebook(NamedTuple):
    """The children of some nodes. Unused slots hold infinite centroids, which are never nearest."""

    parents: pa.Array  # term ids, ascending
    centroids: np.ndarray  # float32 (parents, slots, dim); slot = cluster number


class TreeTable(NamedTuple):
    """A tree, or its upper part, for descent."""

    terms: pa.Array  # all node terms; the root comes first
    inner: np.ndarray  # per node: row in ``children`` and ``centroids``, -1 for a leaf
    children: np.ndarray  # node number of each child, -1 for an unused slot
    centroids: np.ndarray  # float32 (inner nodes, slots, dim)


def vector_matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """A list column as a (rows, dim) matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    rows = len(column)
    if rows == 0:
        return np.empty((0, dim or 0), dtype=flat.dtype)
    width = dim or len(flat) // rows
    lengths = pc.list_value_length(column)
    if pc.any(pc.fill_null(pc.not_equal(lengths, width), True)).as_py():
        raise ValueError(f"every vector must have {width} elements")
    return flat.reshape(rows, width)


def matrix_column(matrix: np.ndarray) -> pa.Array:
    rows, width = matrix.shape
    return pa.ListArray.from_arrays(
        pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(matrix.reshape(-1))
    )


class _Centroids:
    """Centroids ready for comparison: doubles, with squared norms; unused slots get an infinite norm."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.exact = centroids
        self.values = np.where(np.isfinite(centroids), centroids, 0).astype(np.float64)
        self.norms = np.einsum("nkd,nkd->nk", self.values, self.values)
        self.scale = self.norms.max(initial=0.0)
        self.norms[~np.isfinite(centroids).all(axis=2)] = np.inf

    def nearest(self, x: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Slot of the nearest centroid among those of ``row``; ties go to the lower slot.

        |c|^2 - 2 x.c orders the slots as the distance does, up to rounding. Rows whose two best are too close to
        tell are compared once more by differences.
        """
        x = x.astype(np.float64)
        scores = self._scores(x, row)
        slots = scores.argmin(axis=1)
        if scores.shape[1] > 1:
            best_two = np.partition(scores, 1, axis=1)[:, :2]
            slack = 1e-11 * (np.einsum("nd,nd->n", x, x) + self.scale)
            close = np.flatnonzero(best_two[:, 1] - best_two[:, 0] <= slack)
            step = max(1, _BLOCK_BYTES // (self.values.shape[1] * self.values.shape[2] * 8))
            for start in range(0, len(close), step):
                part = close[start : start + step]
                diff = x[part, None, :] - self.exact[row[part]]
                slots[part] = np.einsum("nkd,nkd->nk", diff, diff).argmin(axis=1)
        return slots.astype(np.int32)

    def _scores(self, x: np.ndarray, row: np.ndarray) -> np.ndarray:
        scores = np.empty((len(x), self.values.shape[1]))
        order = np.argsort(row, kind="stable")
        rows, first = np.unique(row[order], return_index=True)
        if len(rows) * 8 <= len(x):
            # Few nodes: one matrix product each.
            for node, start, end in zip(rows, first, np.append(first[1:], len(order))):
                part = order[start:end]
                scores[part] = x[part] @ self.values[node].T
        else:
            step = max(1, _BLOCK_BYTES // (self.values.shape[1] * self.values.shape[2] * 8))
            for start in range(0, len(x), step):
                part = slice(start, start + step)
                scores[part] = np.matmul(self.values[row[part]], x[part, :, None])[:, :, 0]
        return self.norms[row] - 2 * scores

    def squared_distance(self, x: np.ndarray, row: np.ndarray, slots: np.ndarray) -> np.ndarray:
        diff = x.astype(np.float64) - self.values[row, slots]
        return np.einsum("nd,nd->n", diff, diff)


def _rows_of(terms: pa.Array, book: Codebook) -> np.ndarray:
    """Codebook row of each term, -1 where the codebook does not hold it."""
    found = pc.index_in(terms, value_set=book.parents)
    return pc.fill_null(found, -1).to_numpy(zero_copy_only=False)


def descend_udf(tree: Broadcast, dim: int):
    """Term of the node that a vector reaches from the root, going to the nearest child each time."""

    @F.arrow_udf("string")
    def descend(vectors: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = TreeTable(*tree.value)
        centroids = _Centroids(table.centroids)
        for vec in vectors:
            x = vector_matrix(vec, dim)
            node = np.zeros(len(x), dtype=np.int64)
            open_rows = np.arange(len(x))
            while True:
                open_rows = open_rows[table.inner[node[open_rows]] >= 0]
                if len(open_rows) == 0:
                    break
                row = table.inner[node[open_rows]]
                node[open_rows] = table.children[row, centroids.nearest(x[open_rows], row)]
            yield table.terms.take(pa.array(node))

    return descend


def assign_udf(book: Broadcast):
    """Cluster of a vector among the children of its node, null if the codebook does not hold the node."""

    @F.arrow_udf("int")
    def assign(columns: Iterator[Tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        codebook = Codebook(*book.value)
        centroids = _Centroids(codebook.centroids)
        for term, vec in columns:
            row = _rows_of(term, codebook)
            known = row >= 0
            out = np.zeros(len(row), dtype=np.int32)
            if known.any():
                x = vector_matrix(vec, codebook.centroids.shape[2])
                out[known] = centroids.nearest(x[known], row[known])
            yield pa.array(out, mask=~known)

    return assign


def nearest_of_udf(dim: int):
    """Position of the vector nearest to ``vec`` in a row's own list of vectors, laid end to end; null without any."""

    @F.arrow_udf("int")
    def nearest_of(vec: pa.Array, candidates: pa.Array) -> pa.Array:
        x = vector_matrix(vec, dim)
        counts = pc.fill_null(pc.list_value_length(candidates), 0).to_numpy(zero_copy_only=False) // dim
        own = np.full((len(x), max(1, counts.max(initial=0)), dim), np.inf, dtype=np.float32)
        used = np.arange(own.shape[1]) < counts[:, None]
        own[used] = candidates.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        out = np.empty(len(x), dtype=np.int32)
        step = max(1, _BLOCK_BYTES // (own.shape[1] * dim * 8))
        for start in range(0, len(x), step):
            part = slice(start, start + step)
            diff = x[part, None, :].astype(np.float64) - own[part]
            out[part] = np.einsum("nkd,nkd->nk", diff, diff).argmin(axis=1)
        return pa.array(out, mask=counts == 0)

    return nearest_of


def _add_by_group(sums: np.ndarray, counts: np.ndarray, group: np.ndarray, x: np.ndarray, n: np.ndarray | None = None) -> None:
    """Add each row of ``x`` (which stands for ``n`` rows, or one) to its group."""
    order = np.argsort(group, kind="stable")
    groups, first = np.unique(group[order], return_index=True)
    sums[groups] += np.add.reduceat(x[order].astype(np.float64), first, axis=0)
    counts[groups] += np.diff(np.append(first, len(order))) if n is None else np.add.reduceat(n[order], first)


def pack_rows(parents: pa.Array, dim: int, rows: int = 4096):
    """(term_id, vec) -> (node, vecs): the numbers of up to ``rows`` rows' nodes among ``parents`` and their vectors, as bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = pc.fill_null(pc.index_in(batch.column(0), value_set=parents), -1).to_numpy(zero_copy_only=False).astype(np.int32)
            x = vector_matrix(batch.column(1), dim).astype(np.float32, copy=False)
            for at in range(0, len(node), rows):
                part = slice(at, at + rows)
                yield pa.RecordBatch.from_arrays([pa.array([node[part].tobytes()]), pa.array([x[part].tobytes()])], names=["node", "vecs"])

    return pack


def _unpacked(batches: Iterator[pa.RecordBatch], parents: pa.Array, codebook: Codebook) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codebook row, vectors) of what ``pack_rows`` gave, -1 for nodes that the codebook does not hold."""
    row = np.append(_rows_of(parents, codebook), -1)
    for batch in batches:
        for node, vecs in zip(batch.column(0), batch.column(1)):
            x = np.frombuffer(vecs.as_buffer(), np.float32).reshape(-1, codebook.centroids.shape[2])
            yield row[np.frombuffer(node.as_buffer(), np.int32)], x


def cluster_sums(book: Broadcast, packed: pa.Array | None = None):
    """(term_id, vec) -> one row per cluster met in the partition: its size and the sum of its vectors. With ``packed``, the rows are those
    of ``pack_rows`` with these parents."""

    def reduce_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codebook = Codebook(*book.value)
        nodes, slots, dim = codebook.centroids.shape
        centroids = _Centroids(codebook.centroids)
        sums = np.zeros((nodes * slots, dim))
        counts = np.zeros(nodes * slots, dtype=np.int64)
        if packed is None:
            given = ((_rows_of(batch.column(0), codebook), vector_matrix(batch.column(1), dim)) for batch in batches)
        else:
            given = _unpacked(batches, packed, codebook)
        for row, x in given:
            known = row >= 0
            if not known.any():
                continue
            x = x[known]
            slot = centroids.nearest(x, row[known])
            _add_by_group(sums, counts, row[known].astype(np.int64) * slots + slot, x)
        met = np.flatnonzero(counts)
        for part in np.array_split(met, max(1, len(met) // 4096)):
            yield pa.RecordBatch.from_arrays(
                [
                    codebook.parents.take(pa.array(part // slots)),
                    pa.array((part % slots).astype(np.int32)),
                    pa.array(counts[part]),
                    matrix_column(sums[part]),
                ],
                names=["term_id", "cluster", "n", "sums"],
            )

    return reduce_partition


def cluster_counts(book: Broadcast):
    """(term_id, vec) -> (term_id, cluster, n): how many rows of the partition are nearest to each centroid."""

    def reduce_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codebook = Codebook(*book.value)
        nodes, slots, dim = codebook.centroids.shape
        centroids = _Centroids(codebook.centroids)
        counts = np.zeros(nodes * slots, dtype=np.int64)
        for batch in batches:
            row = _rows_of(batch.column(0), codebook)
            known = row >= 0
            if known.any():
                slot = centroids.nearest(vector_matrix(batch.column(1), dim)[known], row[known])
                counts += np.bincount(row[known].astype(np.int64) * slots + slot, minlength=nodes * slots)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [codebook.parents.take(pa.array(met // slots)), pa.array((met % slots).astype(np.int32)), pa.array(counts[met])],
            names=["term_id", "cluster", "n"],
        )

    return reduce_partition


def merge_cluster_sums(partials: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``cluster_sums``, all of a cluster in one partition -> (term_id, cluster, n, centroid)."""
    merged: dict[tuple[str, int], int] = {}
    counts, sums = np.zeros(0, dtype=np.int64), np.zeros((0, 0))
    for batch in partials:
        if batch.num_rows == 0:
            continue
        keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        place = np.array([merged.setdefault(key, len(merged)) for key in keys])
        more = vector_matrix(batch.column(3))
        if len(merged) > len(counts):
            room = max(len(merged), 2 * len(counts))
            counts = np.concatenate([counts, np.zeros(room - len(counts), dtype=np.int64)])
            sums = np.concatenate([sums.reshape(-1, more.shape[1]), np.zeros((room - len(sums), more.shape[1]))])
        _add_by_group(sums, counts, place, more, batch.column(2).to_numpy())
    if merged:
        n = counts[: len(merged)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([term for term, _ in merged]),
                pa.array([cluster for _, cluster in merged], pa.int32()),
                pa.array(n),
                matrix_column((sums[: len(merged)] / n[:, None]).astype(np.float32)),
            ],
            names=["term_id", "cluster", "n", "centroid"],
        )


def seed_race(book: Broadcast, first: bool):
    """(term_id, vec, hash, u) -> the row of each node that wins the partition.

    A row races with time -ln(u) / w, where w is its squared distance to the seeds chosen so far (1 for the first
    seed). The earliest row of a node is then a draw with probability proportional to w, and the minimum over
    partitions is the minimum over all rows.
    """

    def reduce_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codebook = Codebook(*book.value)
        parents, dim = codebook.parents, codebook.centroids.shape[2]
        centroids = _Centroids(codebook.centroids)
        best: dict[int, tuple[float, str, np.ndarray]] = {}
        for batch in batches:
            row = _rows_of(batch.column(0), codebook)
            known = np.flatnonzero(row >= 0)
            if len(known) == 0:
                continue
            x, node = vector_matrix(batch.column(1), dim)[known], row[known]
            u = batch.column(3).to_numpy(zero_copy_only=False)[known]
            weight = 1.0 if first else centroids.squared_distance(x, node, centroids.nearest(x, node))
            with np.errstate(divide="ignore"):
                time = -np.log(np.maximum(u, 2.0**-53)) / weight
            order = np.lexsort((time, node))
            nodes, at = np.unique(node[order], return_index=True)
            for winner, i in zip(nodes, order[at]):
                if np.isfinite(time[i]):
                    entry = (float(time[i]), batch.column(2)[int(known[i])].as_py())
                    if winner not in best or entry < best[winner][:2]:
                        best[winner] = (*entry, x[i].copy())
        if best:
            nodes = sorted(best)
            yield pa.RecordBatch.from_arrays(
                [
                    parents.take(pa.array(nodes)),
                    pa.array([best[i][0] for i in nodes]),
                    pa.array([best[i][1] for i in nodes]),
                    matrix_column(np.stack([best[i][2] for i in nodes]).astype(np.float32)),
                ],
                names=["term_id", "time", "hash", "vec"],
            )

    return reduce_partition


def seed_races(book: Broadcast, take: int):
    """(term_id, vec, hash, u) -> the ``take`` rows of each node that win the partition, by the race of ``seed_race``: together they are
    draws without repeats, each with probability proportional to the squared distance to the seeds so far."""

    def reduce_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codebook = Codebook(*book.value)
        parents, dim = codebook.parents, codebook.centroids.shape[2]
        centroids = _Centroids(codebook.centroids)
        held = None
        for batch in batches:
            row = _rows_of(batch.column(0), codebook)
            known = np.flatnonzero(row >= 0)
            if len(known) == 0:
                continue
            x, node = vector_matrix(batch.column(1), dim)[known], row[known]
            u = batch.column(3).to_numpy(zero_copy_only=False)[known]
            weight = centroids.squared_distance(x, node, centroids.nearest(x, node))
            with np.errstate(divide="ignore"):
                time = -np.log(np.maximum(u, 2.0**-53)) / weight
            hashes = np.array(batch.column(2).take(pa.array(known)).to_pylist())
            running = np.isfinite(time)
            own = (node[running], time[running], hashes[running], x[running])
            held = own if held is None else tuple(np.concatenate(pair) for pair in zip(held, own))
            order = np.lexsort((held[2], held[1], held[0]))
            first = np.searchsorted(held[0][order], held[0][order])
            held = tuple(part[order[np.arange(len(order)) - first < take]] for part in held)
        if held is not None and len(held[0]):
            yield pa.RecordBatch.from_arrays(
                [parents.take(pa.array(held[0])), pa.array(held[1]), pa.array(held[2].tolist(), pa.string()), matrix_column(held[3].astype(np.float32))],
                names=["term_id", "time", "hash", "vec"],
            )

    return reduce_partition


def draw_hashes(salt: str, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """md5 hex of 'salt:key' and its first 52 bits as a number in [0, 1): what ``row_hash`` and ``hash_fraction`` give."""
    hexes = [hashlib.md5(f"{salt}:{key}".encode()).hexdigest() for key in keys]
    return np.array(hexes), np.array([int(h[:13], 16) for h in hexes], np.float64) / float(1 << 52)


def plus_plus(x: np.ndarray, weights: np.ndarray, keys: list[str], k: int, salt: str) -> np.ndarray:
    """k-means++ over the rows of one node, drawn by the same races as over a table: (1, k, dim) with infinite unused slots."""
    centroids = np.full((1, k, x.shape[1]), np.inf, np.float32)
    node = np.zeros(len(x), np.int64)
    for slot in range(k):
        hashes, u = draw_hashes(f"{salt}:{slot}", keys)
        own = weights.astype(np.float64)
        if slot:
            chosen = _Centroids(centroids[:, :slot])
            own = own * chosen.squared_distance(x, node, chosen.nearest(x, node))
        with np.errstate(divide="ignore"):
            time = -np.log(np.maximum(u, 2.0**-53)) / own
        if not np.isfinite(time).any():
            break
        centroids[0, slot] = x[np.lexsort((hashes, time))[0]]
    return centroids


def lloyd(x: np.ndarray, weights: np.ndarray, centroids: np.ndarray, rounds: int, resting) -> np.ndarray:
    """Lloyd rounds over the rows of one node, until ``resting`` or for at most ``rounds``. Clusters without rows vanish."""
    node, slots = np.zeros(len(x), np.int64), centroids.shape[1]
    for _ in range(rounds):
        slot = _Centroids(centroids).nearest(x, node)
        sums, counts = np.zeros((slots, x.shape[1])), np.zeros(slots)
        np.add.at(sums, slot, x.astype(np.float64) * weights[:, None])
        np.add.at(counts, slot, weights)
        moved = np.full_like(centroids, np.inf)
        met = counts > 0
        moved[0, met] = (sums[met] / counts[met, None]).astype(np.float32)
        still = resting(moved, centroids)
        centroids = moved
        if still:
            break
    return centroids


def cluster_whole_node(dim: int, k: int, rounds: int, init: str, salt: str, resting):
    """All rows of one node (term_id, doc_id, pos, vec, key) -> the rows with their child's term, each child's first row with its centroid."""

    def split_node(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("key").combine_chunks()
        x, keys = vector_matrix(rows.column("vec"), dim), rows.column("key").to_pylist()
        ones = np.ones(len(x))
        if init == "hash":
            lowest = np.argsort(draw_hashes(salt, keys)[0], kind="stable")[:k]
            centroids = np.full((1, k, dim), np.inf, np.float32)
            centroids[0, : len(lowest)] = x[lowest]
        else:
            centroids = plus_plus(x, ones, keys, k, salt)
        centroids = lloyd(x, ones, centroids, rounds, resting)
        slot = _Centroids(centroids).nearest(x, np.zeros(len(x), np.int64))
        met, first = np.unique(slot, return_index=True)
        shown = [None] * len(x)
        for s, i in zip(met, first):
            shown[i] = centroids[0, s].tolist()
        term = rows.column("term_id")[0].as_py()
        child = pa.array([f"{term}.{s}" for s in range(k)]).take(pa.array(slot))
        columns = {"term_id": child, **{name: rows.column(name) for name in ("doc_id", "pos", "vec")}}
        return pa.table({**columns, "centroid": pa.array(shown, pa.list_(pa.float32()))})

    return split_node


def reduce_candidates(dim: int, k: int, rounds: int, salt: str, resting):
    """The weighted candidates of one node (term_id, cluster, n, centroid) -> k of their centres (term_id, cluster, centroid)."""

    def reduce_node(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("cluster").combine_chunks()
        term = rows.column("term_id")[0].as_py()
        x, n = vector_matrix(rows.column("centroid"), dim), rows.column("n").to_numpy().astype(np.float64)
        keys = [f"{term}:{c}" for c in rows.column("cluster").to_pylist()]
        centroids = lloyd(x, n, plus_plus(x, n, keys, k, f"{salt}:reduce"), rounds, resting)
        used = np.flatnonzero(np.isfinite(centroids[0]).all(axis=1))
        columns = {"term_id": pa.array([term] * len(used)), "cluster": pa.array(used.astype(np.int32))}
        return pa.table({**columns, "centroid": matrix_column(centroids[0, used])})

    return reduce_node


def densify_udf(dim: int):
    """Bucket numbers of a text's tokens -> L2-normalised counts; a text without tokens gives zeros."""

    @F.arrow_udf("array<float>")
    def densify(buckets: pa.Array) -> pa.Array:
        rows = len(buckets)
        lengths = pc.fill_null(pc.list_value_length(buckets), 0).to_numpy(zero_copy_only=False)
        flat = buckets.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        cell = np.repeat(np.arange(rows, dtype=np.int64), lengths) * dim + flat
        counts = np.bincount(cell, minlength=rows * dim).reshape(rows, dim).astype(np.float64)
        norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        return matrix_column((counts / np.where(norms == 0, 1.0, norms)).astype(np.float32))

    return densify


def _merge_best(best: pa.Table | None, found: pa.Table, n: int) -> pa.Table:
    """(query, doc_id, similarity) rows together, one per query and document, cut to n per query."""
    if best is not None:
        found = pa.concat_tables([best, found])
    found = found.group_by(["query", "doc_id"]).aggregate([("similarity", "max")])
    found = found.rename_columns(["query", "doc_id", "similarity"])
    order = pc.sort_indices(
        found, sort_keys=[("query", "ascending"), ("similarity", "descending"), ("doc_id", "ascending")]
    )
    found = found.take(order)
    place, _ = _places(found)
    return found.filter(pa.array(place < n))


def _places(sorted_rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    query = sorted_rows.column("query").to_numpy()
    first = np.append(True, query[1:] != query[:-1])[: len(query)]
    start = np.maximum.accumulate(np.where(first, np.arange(len(query)), 0))
    return np.arange(len(query)) - start, query


def _unit(x: np.ndarray) -> np.ndarray:
    norms = np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]
    return x / np.where(norms == 0, 1.0, norms)


def angle_udf():
    """Angle between two vectors, and the straight angle (which bounds all) where one of them has no direction."""

    @F.arrow_udf("double")
    def angle(a: pa.Array, b: pa.Array) -> pa.Array:
        x, y = vector_matrix(a).astype(np.float64), vector_matrix(b).astype(np.float64)
        if not len(x):
            return pa.array([], pa.float64())
        cosine = np.einsum("nd,nd->n", _unit(x), _unit(y))
        pathless = ~(x.any(axis=1) & y.any(axis=1))
        return pa.array(np.where(pathless, np.pi, np.arccos(np.clip(cosine, -1, 1))))

    return angle


def nearest_balls(queries: Broadcast, m: int):
    """(term_id, centre, n_docs) -> the m balls of this partition whose centres are nearest to each query's direction."""

    def reduce_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = queries.value
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            scores = matrix @ _unit(vector_matrix(batch.column(1)).astype(np.float64)).T
            if scores.shape[1] > m:
                column = np.argpartition(-scores, m - 1, axis=1)[:, :m]
            else:
                column = np.tile(np.arange(scores.shape[1]), (len(matrix), 1))
            row = np.repeat(np.arange(len(matrix)), column.shape[1])
            column = column.reshape(-1)
            found = pa.table(
                {
                    "query": pa.array(row),
                    "doc_id": batch.column(0).take(pa.array(column)),
                    "similarity": pa.array(scores[row, column]),
                    "n_docs": batch.column(2).take(pa.array(column)),
                }
            )
            held = found if held is None else pa.concat_tables([held, found])
            order = pc.sort_indices(held, sort_keys=[("query", "ascending"), ("similarity", "descending"), ("doc_id", "ascending")])
            held = held.take(order)
            held = held.filter(pa.array(_places(held)[0] < m)).combine_chunks()
        if held is not None:
            yield from held.rename_columns(["query", "term_id", "cosine", "n_docs"]).to_batches()

    return reduce_partition


def open_balls(shared: Broadcast, slack: float, chunk: int):
    """(term_id, upper_id, centre, radius) -> (term_id, queries): the queries that a ball may hold an answer of, in lists of at most
    ``chunk``. ``shared`` is (unit queries, their bars, upper nodes' terms, unit centres, radii): a ball below an upper node is compared with
    the queries that the upper node is open to, and not at all if there are none."""

    def bounds(matrix: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> np.ndarray:
        theta = np.arccos(np.clip(matrix @ centres.T, -1, 1))
        return np.maximum(np.cos(np.maximum(theta - radius[None, :], 0.0)), 0.0) + slack

    def reduce_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, bars, terms, upper_centres, upper_radius = shared.value
        open_above = bounds(matrix, upper_centres, upper_radius) >= bars[:, None]
        for batch in batches:
            above = pc.index_in(batch.column(1), value_set=terms).to_numpy(zero_copy_only=False)
            centres = _unit(vector_matrix(batch.column(2)).astype(np.float64))
            radius = batch.column(3).to_numpy()
            for node in np.unique(above):
                mine, asked = np.flatnonzero(above == node), np.flatnonzero(open_above[:, int(node)])
                if not len(asked):
                    continue
                fits = bounds(matrix[asked], centres[mine], radius[mine]) >= bars[asked][:, None]
                ball, query = np.nonzero(fits.T)
                lists, owners = [], []
                for i in np.unique(ball):
                    own = asked[query[ball == i]]
                    for at in range(0, len(own), chunk):
                        lists.append(own[at : at + chunk].astype(np.int32))
                        owners.append(mine[i])
                if lists:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(owners)), pa.array(lists, pa.list_(pa.int32()))], names=["term_id", "queries"]
                    )

    return reduce_partition


def best_of_lists(shared: Broadcast, n: int, digits: int):
    """(doc_id, vec, queries) -> the n best documents of each query in this partition, every row being compared with the queries of its
    list and no others. ``shared`` is (query ids as an Arrow array, unit queries, their bars). A few of the pairs are held at a time, whatever
    the lists of a batch come to."""

    def reduce_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix, bars = shared.value
        best, bars = None, bars.copy()
        step = max(1, _PAIR_BYTES // (matrix.shape[1] * 8))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(vector_matrix(batch.column(1), matrix.shape[1]).astype(np.float64))
            lists = batch.column(2)
            number = np.diff(lists.offsets.to_numpy())
            query = lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(x)), number)
            for at in range(0, len(row), step):
                r, q = row[at : at + step], query[at : at + step]
                scores = np.round(np.maximum(np.einsum("nd,nd->n", x[r], matrix[q]), 0.0), digits)
                good = scores >= bars[q]
                if good.any():
                    found = {"query": pa.array(q[good]), "doc_id": batch.column(0).take(pa.array(r[good])), "similarity": pa.array(scores[good])}
                    best = _merge_best(best, pa.table(found), n)
                    # The n-th best so far; rows tied with it stay.
                    place, held = _places(best)
                    full = place == n - 1
                    bars[held[full]] = np.maximum(bars[held[full]], best.column("similarity").to_numpy()[full])
        if best is not None and best.num_rows:
            columns = {
                "query_id": ids.take(best.column("query").combine_chunks()),
                "doc_id": best.column("doc_id"),
                "similarity": best.column("similarity"),
            }
            yield from pa.table(columns).combine_chunks().to_batches()

    return reduce_partition


def best_similarities(queries: Broadcast, n: int, digits: int):
    """(doc_id, vec) -> the n best documents per query of this partition, by cosine clamped at 0.

    A document's value is the largest over its vectors. Were a document among the n best overall, then in the
    partition that holds its best vector fewer than n documents come before it, so no partition drops it.
    ``queries`` is (query ids as an Arrow array, unit rows as float64).
    """

    def reduce_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = queries.value
        step = max(1, _SCORE_BYTES // (len(ids) * 8))
        best, bar = None, np.full(len(ids), -1.0)  # bar: the n-th best value so far
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                x = vector_matrix(part.column(1), matrix.shape[1]).astype(np.float64)
                norms = np.sqrt((x * x).sum(axis=1, keepdims=True))
                scores = (x / np.where(norms == 0, 1.0, norms)) @ matrix.T
                docs = pc.dictionary_encode(part.column(0))
                code = docs.indices.to_numpy(zero_copy_only=False)
                order = np.argsort(code, kind="stable")
                _, first = np.unique(code[order], return_index=True)
                scores = np.maximum.reduceat(scores[order], first, axis=0)
                scores = np.round(np.maximum(scores, 0.0), digits)
                if len(scores) > n:
                    bar = np.maximum(bar, np.partition(scores, len(scores) - n, axis=0)[len(scores) - n])
                # Rows tied with the bar stay; the merge orders them by document.
                doc, query = np.nonzero(scores >= bar)
                found = pa.table(
                    {
                        "query": pa.array(query),
                        "doc_id": docs.dictionary.take(pa.array(doc)),
                        "similarity": pa.array(scores[doc, query]),
                    }
                )
                best = _merge_best(best, found, n)
                place, query = _places(best)
                full = place == n - 1
                bar[query[full]] = best.column("similarity").to_numpy()[full]
        if best is not None and best.num_rows:
            columns = {
                "query_id": ids.take(best.column("query").combine_chunks()),
                "doc_id": best.column("doc_id"),
                "similarity": best.column("similarity"),
            }
            yield from pa.table(columns).combine_chunks().to_batches()

    return reduce_partition
