import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bagtree.functions import paths, weights
from bagtree.functions.hashing import hash_fraction, row_hash
from bagtree.functions.vectors import all_close, cosine, l1_normalise, l2_distance, zero_vector
from bagtree.operators.encode import char_ngrams, encode_text, hashed_words, words


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def vec(*xs):
    return F.array(*[F.lit(x).cast("float") for x in xs])


def test_vector_functions(spark):
    assert value(spark, l2_distance(vec(0.0, 3.0), vec(4.0, 0.0))) == 5.0
    assert value(spark, cosine(vec(1.0, 0.0), vec(1.0, 1.0))) == pytest.approx(1 / math.sqrt(2))
    assert value(spark, cosine(vec(0.0, 0.0), vec(1.0, 1.0))) == 0.0
    assert value(spark, l1_normalise(vec(1.0, -3.0))) == [0.25, -0.75]
    assert value(spark, zero_vector(3)) == [0.0, 0.0, 0.0]


@pytest.mark.parametrize("y", [1.0, 1.0 + 5e-6, 1.0 + 2e-5, -1.0])
def test_all_close_is_numpys(spark, y):
    mine = value(spark, all_close(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(y), F.lit(0.0))))
    assert mine == np.allclose([1.0, 0.0], [y, 0.0])
    assert value(spark, all_close(vec(1.0), vec(1.0, 2.0))) is False


def test_weights(spark):
    assert value(spark, weights.idf(F.lit(99), F.lit(9))) == pytest.approx(math.log(10))
    assert value(spark, weights.normalised_tf(F.lit(3), F.lit(2), F.lit(10))) == 0.25
    assert value(spark, weights.rank_discount(F.lit(3))) == 0.5
    assert value(spark, weights.relevance_ratio(F.lit(0.3), F.lit(0.0))) == 0.0
    assert value(spark, weights.relevance_ratio(F.lit(0.3), F.lit(0.6))) == 0.5


@pytest.mark.parametrize("size, ratio", [(3, 0.3), (20, 1.0), (-1, 0.11)])
def test_sample_ratio(spark, size, ratio):
    assert value(spark, weights.sample_ratio(size, F.lit(10))) == pytest.approx(ratio)


def test_sample_ratio_corner_cases(spark):
    assert value(spark, weights.sample_ratio(3, F.lit(0))) is None
    assert value(spark, weights.sample_ratio(-1, F.lit(1))) == 1.0
    with pytest.raises(ValueError):
        weights.sample_ratio(0, F.lit(10))


def test_paths(spark):
    rows = spark.createDataFrame([("0",), ("0.3.17",)], "term_id string")
    got = rows.select(
        paths.terms_on_path("term_id").alias("t"), paths.depth_of(F.col("term_id")).alias("d"), paths.parent_term(F.col("term_id")).alias("p")
    ).collect()
    assert [tuple(r) for r in got] == [(["0"], 0, None), (["0", "0.3", "0.3.17"], 2, "0.3")]


def test_hash_fraction_keeps_the_order_of_the_hash(spark):
    rows = spark.range(500).select(row_hash("s", F.col("id")).alias("h")).withColumn("f", hash_fraction(F.col("h"))).collect()
    assert sorted(rows, key=lambda r: r["h"]) == sorted(rows, key=lambda r: r["f"])
    assert all(0 <= r["f"] < 1 for r in rows)


def test_tokens(spark):
    assert value(spark, words(F.lit(" Aa\tb\n\nÉa "))) == ["aa", "b", "éa"]
    assert value(spark, char_ngrams(F.lit("abcd xy"))) == ["abc", "bcd", "xy"]


def test_default_encoder_has_unit_vectors_and_takes_any_encoder(spark):
    texts = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "id int, text string")
    encoded = {r["id"]: r["vec"] for r in encode_text(texts, hashed_words(16)).collect()}
    assert sum(x * x for x in encoded[1]) == pytest.approx(1, abs=1e-6)
    assert encoded[2] == encoded[3] == [0.0] * 16

    @F.pandas_udf("array<float>")
    def lengths(text):
        return text.fillna("").map(lambda t: [float(len(t))])

    assert {r["id"]: r["vec"] for r in encode_text(texts, lengths).collect()} == {1: [5.0], 2: [0.0], 3: [0.0]}
