"""Repeatable choices: md5 of a salt and the row's key takes the place of random()."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 13 hex digits = 52 bits, the most a double holds exactly.
_DIGITS = 13
_RANGE = float(1 << 52)


def row_hash(salt: str, *keys: Column) -> Column:
    """md5 hex of 'salt:key:key...'."""
    parts = [F.lit(salt)]
    for key in keys:
        parts += [F.lit(":"), key.cast("string")]
    return F.md5(F.concat(*parts))


def hash_fraction(hex_hash: Column) -> Column:
    """The hash as a number in [0, 1); keeps the order of the hex text."""
    return F.conv(F.substring(hex_hash, 1, _DIGITS), 16, 10).cast("bigint") / F.lit(_RANGE)


def hash_bucket(hex_hash: Column, buckets: int) -> Column:
    """The first 32 bits of the hash modulo the number of buckets."""
    return F.pmod(F.conv(F.substring(hex_hash, 1, 8), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")
