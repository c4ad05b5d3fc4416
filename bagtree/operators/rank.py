"""Taking the first rows of each group in hash order, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bagtree.functions.hashing import hash_fraction

BUCKETS = 256


def first_by_hash(rows: DataFrame, group: list[str], hash_column: str, ties: list[str], take: Column, buckets: int = BUCKETS) -> DataFrame:
    """The first ``take`` rows of each group in the order of ``hash_column`` (md5 hex), then of ``ties``.

    A plain row_number would sort a whole group in one task. Here the leading bits of the hash cut each group
    into about equal buckets, the counts tell how many rows come before a bucket, and rows are numbered within
    their bucket only. Buckets behind the cut leave before the sort. ``take`` may use the rows' columns, if
    constant within the group, and ``group_n``, the group's size.
    """
    keys = [*group, "bucket"]
    bucketed = rows.withColumn("bucket", F.floor(hash_fraction(F.col(hash_column)) * buckets).cast("int"))
    of_group = Window.partitionBy(*group)
    bounds = (
        bucketed.groupBy(*keys)
        .agg(F.count("*").alias("bucket_n"))
        .withColumn("group_n", F.sum("bucket_n").over(of_group))
        .withColumn("before", F.sum("bucket_n").over(of_group.orderBy("bucket")) - F.col("bucket_n"))
        .drop("bucket_n")
    )
    order = Window.partitionBy(*keys).orderBy(hash_column, *ties)
    return (
        bucketed.join(bounds, keys)
        .withColumn("take", take)
        .filter(F.col("before") < F.col("take"))
        .withColumn("place", F.row_number().over(order) + F.col("before"))
        .filter(F.col("place") <= F.col("take"))
        .select(*rows.columns)
    )
