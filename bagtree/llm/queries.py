"""One query per operator, over its whole table, and the SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagtree.llm import (
    covertree,
    dartminhash,
    decontaminate,
    language,
    pfair,
    phrases,
    pitman_yor,
    products,
    rules,
    separators,
    shards,
    token_files,
    toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT q.vec_id AS query_id, p.vec_id,
               CAST(list_sum(list_transform(list_zip(q.vec, p.vec), lambda z: z[1] * z[2])) AS BIGINT) AS score
        FROM v q JOIN v p ON q.vec_id <> p.vec_id
        WHERE q.vec_id % 50 = 0
    ), ranked AS (
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
               vec_id, score
        FROM scored
    )
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """
)
def op2_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").where(products.finite(F.col("embedding")))
    scaled = vectors.select("vec_id", products.scaled(F.col("embedding")).alias("vec"))
    return products.top_products(scaled, F.col("vec_id") % 50 == 0, k=5)


@query()
def op3_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_digest(table(spark, sf_dir, "documents"), shards=16)


@query()
def op5_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = pfair.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.drop("text")


@query()
def op7_range_coded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return token_files.read_documents(token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer))


@query()
def op9_separator_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return separators.document_token_counts(table(spark, sf_dir, "documents"), tokenizer)


@query()
def op4_dart_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


@query()
def op6_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op8_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(documents, labels.where(~toxicity.held_out(F.col("doc_id"))))
    scored = model.score(documents)
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query()
def op10_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return pitman_yor.score_documents(documents, toxicity.held_out(F.col("doc_id"), parts=10))


@query()
def op1_page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "pages"), language.train(table(spark, sf_dir, "documents")))


@query(
    r"""
    WITH d AS (
        SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text,
               regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
               list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
        FROM documents
    ), windows AS (
        SELECT row, i, words[i:i + 4] AS part FROM (SELECT row, words, unnest(range(1, len(words) - 3)) AS i FROM d)
    ), twice AS (
        SELECT row, unnest(list(i)) AS i FROM windows GROUP BY row, part HAVING count(*) >= 2
    ), repeated AS (
        SELECT row, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(range(5)) AS j) GROUP BY row
    ), measured AS (
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
               CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
               CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
               CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
               CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
               length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^a-z]', '', 'g')) AS n_lower,
               length(regexp_replace(text, '[^!?]', '', 'g')) AS n_marks,
               coalesce(list_max(list_transform(words, lambda w: strlen(w))), 0) AS longest_word,
               len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS n_echoes
        FROM d LEFT JOIN repeated USING (row)
    ), judged AS (
        SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
               10 * n_symbols > n_words OR (n_dup_lines >= 2 AND 100 * n_dup_lines > 30 * n_lines)
               OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 100 * n_upper > 40 * (n_upper + n_lower)
               OR 100 * n_marks > 30 * n_words OR longest_word > 1000 OR 100 * n_echoes > 30 * n_words AS more_failed
        FROM measured
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND NOT more_failed AS kept
    FROM judged
    """
)
def op11_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.ledger(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~rules.passes(rules.BASE)).alias("base_failed"),
        rules.passes(rules.POLICIES["2"]).alias("kept"),
    )


@query(
    r"""
    WITH p AS (
        SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
        FROM (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(
                coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        )
    ), f1 AS (
        SELECT lang, w, CAST(count(*) AS HUGEINT) AS f FROM (SELECT lang, unnest(w) AS w FROM p) GROUP BY ALL
    ), totals AS (
        SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY lang
    ), f2 AS (
        SELECT lang, w[i] AS w1, w[i + 1] AS w2, CAST(count(*) AS HUGEINT) AS f
        FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM p) GROUP BY ALL HAVING count(*) >= 10
    ), f3 AS (
        SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3, CAST(count(*) AS HUGEINT) AS f
        FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM p) GROUP BY ALL HAVING count(*) >= 10
    ), cuts AS (
        SELECT c.lang, w1 || ' ' || w2 AS phrase, c.f AS a, 1 AS k, x.f AS l, y.f AS r
        FROM f2 c JOIN f1 x ON x.lang = c.lang AND x.w = w1 JOIN f1 y ON y.lang = c.lang AND y.w = w2
        UNION ALL
        SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, 1, x.f, y.f
        FROM f3 c JOIN f1 x ON x.lang = c.lang AND x.w = c.w1 JOIN f2 y ON y.lang = c.lang AND y.w1 = c.w2 AND y.w2 = c.w3
        UNION ALL
        SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, 2, x.f, y.f
        FROM f3 c JOIN f2 x ON x.lang = c.lang AND x.w1 = c.w1 AND x.w2 = c.w2 JOIN f1 y ON y.lang = c.lang AND y.w = c.w3
    ), lowest AS (
        SELECT *, (1000000 * a * a) // (l * r) AS score FROM cuts
        QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
    ), inside AS (
        SELECT lang, phrase, max(f) AS longer
        FROM (SELECT lang, w1 || ' ' || w2 AS phrase, f FROM f3 UNION ALL SELECT lang, w2 || ' ' || w3, f FROM f3) GROUP BY ALL
    ), ranked AS (
        SELECT lowest.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
        FROM lowest LEFT JOIN inside USING (lang, phrase)
        WHERE NOT (100 * coalesce(longer, 0) >= 50 * a)
    )
    SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
    FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """
)
def op12_son_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrases.phrases(table(spark, sf_dir, "documents"), support=10, longest=3, cover=(50, 100))
    best = phrases.first_phrases(found, first=2000)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@query(
    """
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT q.vec_id AS anchor_id, p.vec_id, q.label = p.label AS same,
               CAST(list_sum(list_transform(list_zip(q.vec, p.vec), lambda z: z[1] * z[2])) AS BIGINT) AS score
        FROM v q JOIN v p ON q.vec_id <> p.vec_id WHERE q.vec_id % 100 = 0
    ), positives AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
    ), ranked AS (
        SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score,
               CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
        FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
        WHERE 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
    )
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
    """
)
def op13_cover_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").where(products.finite(F.col("embedding")))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    scaled = vectors.select("vec_id", moved.alias("label"), products.scaled(F.col("embedding")).alias("vec"))
    return covertree.hard_negatives(scaled, F.col("vec_id") % 100 == 0, positives=5, negatives=5, low=(80, 100))
