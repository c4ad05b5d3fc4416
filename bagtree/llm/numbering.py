"""Gapless numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 10_000


def hash_bits(total_rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """How many leading bits of a hash make buckets of about ``rows_per_bucket`` rows."""
    return max(0, (max(1, -(-total_rows // rows_per_bucket)) - 1).bit_length())


def leading(hash64: Column, bits: int) -> Column:
    """The leading bits of a 64-bit hash: ascending buckets hold ascending (unsigned) hashes."""
    return F.shiftrightunsigned(hash64, 64 - bits).cast("int") if bits else F.lit(0)


def unsigned_order(hash64: Column) -> Column:
    """A bigint that sorts as the unsigned value of ``hash64``."""
    return hash64.bitwiseXOR(F.lit(-(1 << 63)).cast("bigint"))


def numbered(df: DataFrame, groups: list[str], bucket: str, order: list[Column], out: str) -> DataFrame:
    """Number the rows of each group from 0 in the order (``bucket``, ``order``).

    No group is sorted in one task: rows are numbered within (group, bucket), and the counts of the buckets, one row
    each, give where a bucket begins. The one shuffle of ``df`` is by (groups, bucket), the join uses it again.
    """
    keys = [*groups, bucket]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(k).alias(f"_{k}") for k in keys],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
    )
    within = df.withColumn("_within", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    joined = within.join(starts, same, "left")
    return joined.withColumn(out, F.col("_within") - 1 + F.col("_start")).drop(
        "_within", "_start", *[f"_{k}" for k in keys]
    )
