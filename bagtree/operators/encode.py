"""Text to vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagtree.functions.hashing import hash_bucket
from bagtree.functions.kernels import densify_udf

Encoder = Callable[[Column], Column]


def words(text: Column) -> Column:
    """Lower-case words, separated by blanks, tabs and line ends."""
    return F.filter(F.split(F.lower(text), "[ \n\r\t]+"), lambda w: w != "")


def char_ngrams(text: Column, n: int = 3) -> Column:
    """Character n-grams of each word; a shorter word stands for itself."""
    return F.flatten(
        F.transform(
            words(text),
            lambda w: F.transform(
                F.sequence(F.lit(1), F.greatest(F.length(w) - (n - 1), F.lit(1))), lambda i: F.substr(w, i, F.lit(n))
            ),
        )
    )


def token_buckets(tokens: Column, dim: int) -> Column:
    return F.transform(tokens, lambda token: hash_bucket(F.md5(token), dim))


def hashed_words(dim: int = 64, tokens: Encoder = words) -> Encoder:
    """The default encoder: L2-normalised counts of hashed tokens."""
    return lambda text: densify_udf(dim)(token_buckets(tokens(text), dim))


def encode_text(captions: DataFrame, encoder: Encoder, text: str = "text") -> DataFrame:
    """Adds ``vec``. ``encoder`` maps a text column to array<float>, be it expressions or any Arrow or pandas UDF."""
    return captions.withColumn("vec", encoder(F.col(text)))


def hashed_term_weights(texts: DataFrame, keys: list[str], dim: int, tokens: Encoder = words, text: str = "text") -> DataFrame:
    """The default encoding in sparse form: (keys..., bucket, w), non-zero elements only."""
    counts = (
        texts.select(*keys, F.explode(token_buckets(tokens(F.col(text)), dim)).alias("bucket"))
        .groupBy(*keys, "bucket")
        .agg(F.count("*").alias("n"))
    )
    norms = counts.groupBy(*keys).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norms, keys).select(*keys, "bucket", (F.col("n") / F.col("norm")).alias("w"))
