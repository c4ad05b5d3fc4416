"""Exact top-k inner products by norm buckets, after LEMP (Teflioudi, Gemulla, Mykytiuk 2015).

All vectors are stored in order of their length, longest first; what a task reads at a time is a bucket of vectors of much the
same length. For a query with the lower bound ``theta`` on its k-th best product, a bucket whose longest vector has length l
needs a cosine of ``theta / (|q| l)`` at least:

* above 1 the bucket is passed over;
* where it is high, *coordinate pruning*: a vector with that cosine must have each of the query's largest coordinates in a
  narrow interval, found by binary search in the bucket's sorted coordinates;
* else *length pruning*: only the leading vectors with ``|p| >= theta / |q|``.

What is left is verified by its product. The bound starts from the longest vectors and a hashed sample (real candidates, so it
is a true bound) and rises while a task goes through its buckets. Queries come in blocks of bounded size, one pass over
the vectors per block, which is the only thing that is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bagtree.sources.scratch import stage, unstage

_SCORED = "query_id long, vec_id long, score long"
_LONG = np.iinfo(np.int64)


def finite(vec: Column) -> Column:
    """Whether a vector is there and all of its components are finite numbers."""
    bound = F.lit(float("inf"))
    good = F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < bound), F.lit(False)))
    return F.coalesce(good, F.lit(False))


def scaled(vec: Column, factor: int = 256) -> Column:
    """floor(factor * x) of every component, taken as double."""
    return F.transform(vec, lambda x: F.floor(F.lit(float(factor)) * x.cast("double")).cast("long"))


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Integer rows of width ``dim``; shorter vectors end in zeros."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lengths = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == dim).all():
        return values.reshape(len(lengths), dim)
    out = np.zeros((len(lengths), dim), np.int64)
    for row, part in enumerate(np.split(values, np.cumsum(lengths)[:-1]) if len(lengths) else []):
        out[row, : min(dim, len(part))] = part[:dim]
    return out


def products(queries: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """Exact integer products as int64: in doubles where they are exact there, else in Python's integers, cut to a long."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(probes).max(initial=0)) * max(1, queries.shape[1])
    if most < 2.0**53:
        return (queries.astype(np.float64) @ probes.astype(np.float64).T).astype(np.int64)
    exact = queries.astype(object) @ probes.astype(object).T
    return np.clip(exact, _LONG.min, _LONG.max).astype(np.int64)


class BestK:
    """The k best distinct ids of each query, best score first, ties to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.query = np.empty(0, np.int64)
        self.ids = np.empty(0, np.int64)
        self.scores = np.empty(0, np.int64)
        self.theta = np.full(queries, -np.inf)

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(query):
            return
        query, ids, scores = (np.concatenate(x) for x in ((self.query, query), (self.ids, ids), (self.scores, scores)))
        order = np.lexsort((~scores, ids, query))  # equal ids together, the best first; ~s falls as s rises
        query, ids, scores = query[order], ids[order], scores[order]
        first = np.ones(len(query), bool)
        first[1:] = (query[1:] != query[:-1]) | (ids[1:] != ids[:-1])
        query, ids, scores = query[first], ids[first], scores[first]
        order = np.lexsort((ids, ~scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        start = np.searchsorted(query, query, side="left")
        rank = np.arange(len(query)) - start
        keep = rank < self.k
        self.query, self.ids, self.scores = query[keep], ids[keep], scores[keep]
        last = rank == self.k - 1
        self.theta[query[last]] = np.maximum(self.theta[query[last]], scores[last].astype(np.float64))


class Searcher:
    """Goes through buckets for one block of queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, theta: np.ndarray, k: int, coordinate_from: float, focus: int):
        self.ids, self.vectors, self.seed = ids, vectors, theta
        self.norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
        with np.errstate(invalid="ignore", divide="ignore"):
            self.units = np.nan_to_num(vectors / self.norms[:, None])
        self.best = BestK(len(ids), k)
        self.coordinate_from, self.focus = coordinate_from, focus
        self.verified = 0

    def bucket(self, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray) -> None:
        """One bucket, in any order: a batch may run over several files, which are not read in the order of their lengths."""
        if (norms[1:] > norms[:-1]).any():
            order = np.argsort(-norms, kind="stable")
            ids, vectors, norms = ids[order], vectors[order], norms[order]
        theta = np.maximum(self.seed, self.best.theta)
        longest = norms[0] if len(norms) else 0.0
        reach = self.norms * longest
        with np.errstate(invalid="ignore", divide="ignore"):
            cosine = np.where(reach > 0, theta / reach, np.where(theta > 0, np.inf, -np.inf))
        cosine = cosine - 1e-9
        by_coordinate = np.flatnonzero((cosine <= 1) & (cosine >= self.coordinate_from))
        by_length = np.flatnonzero(cosine < self.coordinate_from)
        self.found: list[tuple[np.ndarray, ...]] = []
        self._coordinates(by_coordinate, cosine, theta, ids, vectors, norms)
        self._lengths(by_length, theta, ids, vectors, norms)
        if self.found:
            self.best.add(*(np.concatenate(x) for x in zip(*self.found)))

    def _keep(self, query, row, scores, theta, ids) -> None:
        """Set aside the k best of each query in this bucket."""
        good = (scores >= theta[query]) & (self.ids[query] != ids[row])
        own = BestK(len(self.ids), self.best.k)
        own.add(query[good], ids[row[good]], scores[good])
        self.found.append((own.query, own.ids, own.scores))

    def _coordinates(self, chosen, cosine, theta, ids, vectors, norms) -> None:
        if not len(chosen):
            return
        with np.errstate(invalid="ignore", divide="ignore"):
            units = np.nan_to_num(vectors / norms[:, None])
        order, found_query, found_row, found_score = {}, [], [], []
        for q in chosen:
            unit, t = self.units[q], min(cosine[q], 1.0)
            focus = np.argsort(-np.abs(unit))[: self.focus]
            # Within the angle arccos(t) of the query, a coordinate's own angle moves by no more than that.
            angle, most = np.arccos(np.clip(unit[focus], -1, 1)), np.arccos(np.clip(t, -1, 1))
            low = np.cos(np.minimum(np.pi, angle + most)) - 1e-9
            high = np.cos(np.maximum(0.0, angle - most)) + 1e-9
            ranges = []
            for f, lo, hi in zip(focus, low, high):
                if f not in order:
                    by = np.argsort(units[:, f], kind="stable")
                    order[f] = by, units[by, f]
                by, values = order[f]
                ranges.append((np.searchsorted(values, lo), np.searchsorted(values, hi, side="right")))
            least = min(range(len(focus)), key=lambda i: ranges[i][1] - ranges[i][0])
            rows = order[focus[least]][0][ranges[least][0] : ranges[least][1]]
            for i, f in enumerate(focus):
                if i != least and len(rows):
                    value = units[rows, f]
                    rows = rows[(value >= low[i]) & (value <= high[i])]
            if len(rows):
                self.verified += len(rows)
                scores = products(self.vectors[q : q + 1], vectors[rows])[0]
                good = scores >= theta[q]
                found_query.append(np.full(good.sum(), q))
                found_row.append(rows[good])
                found_score.append(scores[good])
        if found_query:
            query, row, scores = (np.concatenate(x) for x in (found_query, found_row, found_score))
            self._keep(query, row, scores, theta, ids)

    def _lengths(self, chosen, theta, ids, vectors, norms, step: int = 64) -> None:
        with np.errstate(invalid="ignore", divide="ignore"):
            least = np.where(self.norms[chosen] > 0, theta[chosen] / self.norms[chosen], -np.inf) * (1 - 1e-9) - 1e-9
        prefix = np.searchsorted(-norms, -least, side="right")
        order = np.argsort(prefix, kind="stable")
        for at in range(0, len(order), step):
            part = order[at : at + step]
            rows = int(prefix[part].max(initial=0))
            if not rows:
                continue
            block = chosen[part]
            self.verified += rows * len(block)
            scores = products(self.vectors[block], vectors[:rows])
            q, row = np.nonzero(scores >= theta[block][:, None])
            self._keep(block[q], row, scores[q, row], theta, ids)


def top_products(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    rows_per_bucket: int = 20_000,
    query_block_bytes: int = 16 << 20,
    seed_rows: int = 4096,
    coordinate_from: float = 0.7,
    focus: int = 3,
) -> DataFrame:
    """For each query its k best other vectors: query_id, rank (from 1), vec_id, score.

    ``vectors``: vec_id long, vec array<long>; ``is_query`` says by vec_id which rows ask. Ids are keys: rows that share one are
    forms of one vector, of which the best form counts, and never answer their own query. Vectors of
    different widths are compared as if the shorter ended in zeros. Rows with a null id or vector take no part. Scores
    beyond a long are cut to it. Fewer than k others give fewer rows; an empty table gives none.
    """
    spark = vectors.sparkSession
    usable = vectors.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).select(
        "vec_id",
        "vec",
        F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("norm"),
    )
    shape = usable.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim")).first()
    rows, dim = shape["n"], shape["dim"] or 0
    buckets = max(1, -(-rows // rows_per_bucket))
    # By length and then id, so vectors of one length (or copies of one vector) spread over buckets.
    probes = stage(
        usable.repartitionByRange(buckets, F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id"),
        "probes",
    )
    seeds = [
        probes.orderBy(F.desc("norm"), "vec_id").limit(seed_rows // 2).select("vec_id", "vec").toArrow(),
        probes.orderBy(F.xxhash64("vec_id"), "vec_id").limit(seed_rows // 2).select("vec_id", "vec").toArrow(),
    ]
    seed_ids = np.concatenate([s["vec_id"].to_numpy() for s in seeds])
    seed_vectors = np.concatenate([_matrix(s["vec"], dim) for s in seeds])

    asked = probes.where(is_query)
    per_block = max(64, query_block_bytes // (8 * max(1, dim)))
    blocks = max(1, -(-asked.count() // per_block))
    answers = None
    for number in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number) if blocks > 1 else asked
        table = block.select("vec_id", "vec").toArrow()
        ids, matrix = table["vec_id"].to_numpy(), _matrix(table["vec"], dim)
        start = BestK(len(ids), k)
        for at in range(0, len(ids), 64):
            part = slice(at, at + 64)
            scores = products(matrix[part], seed_vectors)
            q, s = np.nonzero(ids[part][:, None] != seed_ids[None, :])
            start.add(q + at, seed_ids[s], scores[q, s])
        shared = spark.sparkContext.broadcast((ids, matrix, start.theta))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, matrix, theta = shared.value
            searcher = Searcher(ids, matrix, theta, k, coordinate_from, focus)
            for batch in batches:
                if batch.num_rows and len(ids):
                    searcher.bucket(batch["vec_id"].to_numpy(), _matrix(batch["vec"], dim), batch["norm"].to_numpy())
            best = searcher.best
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[best.query], pa.int64()), pa.array(best.ids, pa.int64()), pa.array(best.scores, pa.int64())],
                names=["query_id", "vec_id", "score"],
            )

        found = probes.mapInArrow(search, _SCORED).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        top = stage(found.withColumn("rank", rank).where(F.col("rank") <= k), "top")
        shared.destroy()
        answers = top if answers is None else answers.unionByName(top)
    unstage(probes)
    return answers.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
