"""Vector functions and single clustering steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from bagtree.catalog import sql
from bagtree.catalog.data import DIM, SHAPE, picture_features, table
from bagtree.catalog.registry import query
from bagtree.functions.paths import ROOT
from bagtree.functions.vectors import all_close, clamp_at_zero, cosine, l1_normalise, l2_distance
from bagtree.operators import cluster
from bagtree.sources.scratch import stage

_PAIRS = "embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def _neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    following = table(spark, sf_dir, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return vectors.join(following, "vec_id")


@query(
    f"SELECT a.vec_id, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS distance FROM {_PAIRS}"
)
def l2_pairs(spark, sf_dir):
    """L2 distance of each vector and the next."""
    return _neighbours(spark, sf_dir).select("vec_id", F.round(l2_distance(F.col("a"), F.col("b")), 6).alias("distance"))


@query(
    f"""SELECT vec_id, round(c, 6) AS cosine, round(greatest(c, 0), 6) AS clamped FROM (SELECT a.vec_id,
        list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS c FROM {_PAIRS})"""
)
def cosine_pairs(spark, sf_dir):
    """Cosine similarity of each vector and the next, as it is and not below 0."""
    similarity = cosine(F.col("a"), F.col("b"))
    return _neighbours(spark, sf_dir).select(
        "vec_id", F.round(similarity, 6).alias("cosine"), F.round(clamp_at_zero(similarity), 6).alias("clamped")
    )


@query("SELECT vec_id, vec_id % 3 < 2 AS close, false AS close_to_next FROM embeddings")
def allclose_pairs(spark, sf_dir):
    """Equality within tolerance: each vector against itself stretched by 0, 0.8 or 1.6 hundred-thousandths."""
    vectors = table(spark, sf_dir, "embeddings")
    stretched = F.transform(
        "embedding", lambda x: x.cast("double") * (F.lit(1.0) + (F.col("vec_id") % 3) * F.lit(8e-6))
    )
    rotated = F.concat(F.slice("embedding", 2, DIM - 1), F.slice("embedding", 1, 1))
    return vectors.select(
        "vec_id",
        all_close(stretched, F.col("embedding"), atol=0.0).alias("close"),
        all_close(rotated, F.col("embedding")).alias("close_to_next"),
    )


@query(
    """WITH e AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings),
       n AS (SELECT vec_id, x / sum(abs(x)) OVER (PARTITION BY vec_id) AS x FROM e)
       SELECT vec_id, round(max(x), 6) AS largest, round(min(x), 6) AS smallest, round(sum(abs(x)), 6) AS total
       FROM n GROUP BY vec_id"""
)
def l1_normalised(spark, sf_dir):
    """L1-normalised vectors, described by their range and sum."""
    normed = table(spark, sf_dir, "embeddings").select("vec_id", l1_normalise(F.col("embedding")).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + F.abs(x))
    return normed.select(
        "vec_id",
        F.round(F.array_max("v"), 6).alias("largest"),
        F.round(F.array_min("v"), 6).alias("smallest"),
        F.round(total, 6).alias("total"),
    )


_ROWS = [sql.PICTURES, "root AS (SELECT '0' AS term_id, doc_id, pos, v FROM pics)"]
_SEEDS = [*_ROWS, f"seeds AS ({sql.seeds('root', 10)})"]
_LABELLED = "SELECT r.*, n.cluster FROM root r JOIN ({}) n USING (term_id, doc_id, pos)"
_KEYS = "term_id, doc_id, pos"
_ONE = [*_SEEDS, f"first AS ({_LABELLED.format(sql.nearest('root', 'seeds', _KEYS))})", f"m1 AS ({sql.means('first')})"]
_TWO = [*_ONE, f"second AS ({_LABELLED.format(sql.nearest('root', 'm1', _KEYS))})", f"m2 AS ({sql.means('second')})"]


def _root_rows(spark, sf_dir):
    return picture_features(spark, sf_dir).select(F.lit(ROOT).alias("term_id"), "doc_id", "pos", "vec")


def _fit(spark, sf_dir, iters):
    rows = _root_rows(spark, sf_dir)
    return rows, cluster.fit(rows, [(ROOT, rows.count())], 10, DIM, iters, "hash", SHAPE.salt)


@query(sql.with_ctes(_SEEDS, "SELECT cluster, round(list_sum(c), 6) AS centroid_sum FROM seeds"))
def kmeans_seeds(spark, sf_dir):
    """The ten seeds of the whole set by lowest hash."""
    rows = _root_rows(spark, sf_dir)
    found = cluster.hash_seeds(rows, [(ROOT, rows.count())], 10, SHAPE.salt)
    return found.select("cluster", _vector_sum("centroid"))


@query(sql.with_ctes(_TWO, "SELECT doc_id, pos, cluster FROM second"))
def kmeans_assign(spark, sf_dir):
    """The nearest of ten centres for every vector after one round; also the nearest-child join."""
    rows, book = _fit(spark, sf_dir, 1)
    return cluster.assign(rows, book).select("doc_id", "pos", "cluster")


@query(
    sql.with_ctes(
        _TWO,
        """SELECT cluster, (SELECT count(*) FROM second s WHERE s.cluster = m2.cluster) AS n,
           round(list_sum(c), 4) AS centroid_sum FROM m2""",
    )
)
def kmeans_update(spark, sf_dir):
    """Sizes and centres after two rounds."""
    rows, book = _fit(spark, sf_dir, 1)
    return cluster.cluster_means(rows, book).select("cluster", "n", _vector_sum("centroid", 4))


@query()
def kmeans_plus_plus(spark, sf_dir):
    """k-means++ seeds, rounds until nothing moves, then the size and mean squared distance of each cluster."""
    rows = _root_rows(spark, sf_dir)
    book = cluster.fit(rows, [(ROOT, rows.count())], 10, DIM, 20, "kmeans++", SHAPE.salt)
    return cluster.cluster_means(rows, book).select("cluster", "n", _vector_sum("centroid"))


_CHECKED = " UNION ALL ".join(
    f"""SELECT '{init}' AS init, count(*) AS n_rows, 10 AS n_clusters, 0 AS n_misplaced, 0 AS n_off_mean, true AS spreads_less
        FROM embeddings""" for init in ("kmeans++", "kmeans||")
)


@query(_CHECKED)
def kmeans_seeded(spark, sf_dir):
    """What holds of a clustering that rests, whatever its seeds: every row is in a cluster, none empty, each row with the nearest
    centroid, each centroid the mean of its rows, and the rows lie nearer to their centroids than to their common mean."""
    rows = stage(_root_rows(spark, sf_dir), "rows")
    checked = None
    for init in ("kmeans++", "kmeans||"):
        book = cluster.fit(rows, [(ROOT, rows.count())], 10, DIM, cluster.MAX_ROUNDS, init, SHAPE.salt)
        centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]).cast("array<float>") for c in book.centroids[0]])
        distances = F.transform(centres, lambda c: l2_distance(F.col("vec"), c))
        placed = cluster.assign(rows, book).withColumn("distances", distances)
        least = F.array_min("distances")
        joined = stage(placed.select("vec", "cluster", least.alias("near"), (F.array_position("distances", least) - 1).alias("nearest")), "joined")
        off = joined.filter(F.col("cluster") != F.col("nearest")).count()
        means = cluster.to_codebook(cluster.cluster_means(rows, book).select("term_id", "cluster", "centroid").toArrow(), 10, DIM)
        apart = int((np.abs(means.centroids - book.centroids).max(axis=(0, 2)) > 1e-4).sum())
        whole = cluster.Codebook(book.parents, np.mean(book.centroids, axis=1, keepdims=True))
        common = cluster.to_codebook(cluster.cluster_means(rows, whole).toArrow(), 1, DIM).centroids[0, 0].tolist()
        around = F.array(*[F.lit(x) for x in common]).cast("array<float>")
        spread = joined.agg(F.sum(F.pow("near", F.lit(2.0))), F.sum(F.pow(l2_distance(F.col("vec"), around), F.lit(2.0)))).first()
        row = (init, joined.count(), joined.select("cluster").distinct().count(), off, apart, spread[0] < spread[1])
        one = spark.createDataFrame([row], "init string, n_rows long, n_clusters int, n_misplaced int, n_off_mean int, spreads_less boolean")
        checked = one if checked is None else checked.unionByName(one)
    return checked


def _vector_sum(column, digits=6):
    return F.round(F.aggregate(column, F.lit(0.0), lambda acc, x: acc + x.cast("double")), digits).alias("centroid_sum")
