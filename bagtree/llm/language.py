"""Language of web pages by Bayesian evidence fusion.

The posterior of a page's language is the product of four terms:

* text: a naive Bayes likelihood of the hashed byte trigrams of the visible text, with counts from labelled documents; it is
  scaled so that a long text weighs as much as ``effective_grams`` independent trigrams, as its trigrams are not independent;
* markup: P(declared language | language);
* address: P(suffix of the host | language);
* host prior: P(language | host), smoothed towards the host's registered domain, and that towards all pages.

The last three come from grouped counts over all pages of what the text alone says, with the page's own count taken out of its
host's and domain's. Counting is partial before it is shuffled, so a host with a third of all pages is one row per task.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagtree.llm.words import chunks, mix, slices
from bagtree.sources.scratch import stage

BUCKETS = 1 << 15
MAX_LANGUAGES = 256
EFFECTIVE_GRAMS = 60.0
_HIDDEN = re.compile(r"(?is)<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*>")
_SPACE = re.compile(rb"[\x00-\x20]+")


def visible_text(page: str | None) -> str:
    """A page's text without tags, comments, scripts and styles."""
    return html.unescape(_HIDDEN.sub(" ", page or ""))


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of all byte trigrams of the lower-cased texts, white space as one space on both ends of a word."""
    encoded = [b" " + _SPACE.sub(b" ", (t or "").lower().encode("utf-8", "surrogatepass")).strip() + b" " for t in texts]
    data = np.frombuffer(b"".join(encoded), np.uint8).astype(np.uint64)
    lengths = np.array([len(e) for e in encoded], np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    if len(data) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = owner[:-2] == owner[2:]
    code = (data[:-2] << np.uint64(16)) | (data[1:-1] << np.uint64(8)) | data[2:]
    return (mix(code[inside]) >> np.uint64(64 - 15)).astype(np.int64), owner[:-2][inside]


class TrigramModel:
    """Languages and their log probabilities of the buckets."""

    def __init__(self, languages: list[str], counts: np.ndarray, smoothing: float = 0.5):
        self.languages = languages
        share = (counts + smoothing) / (counts.sum(1, keepdims=True) + smoothing * BUCKETS)
        self.logs = np.log(share).astype(np.float32)

    def likelihoods(self, texts: list[str | None], effective: float) -> np.ndarray:
        """(texts, languages): scaled log likelihoods; zeros for a text without trigrams."""
        out = np.zeros((len(texts), len(self.languages)))
        for piece in chunks(texts):
            bucket, owner = trigrams(texts[piece])
            docs = piece.stop - piece.start
            n = np.bincount(owner, minlength=docs)
            scale = np.minimum(n, effective) / np.maximum(n, 1)
            for k, row in enumerate(self.logs):
                out[piece, k] = np.bincount(owner, row[bucket], docs) * scale
        return out


def train(documents: DataFrame, max_languages: int = MAX_LANGUAGES) -> TrigramModel:
    """Counts over all documents (text, lang) whose lang is not null, lower-cased."""
    labelled = documents.where("lang IS NOT NULL AND text IS NOT NULL").select(F.lower("lang").alias("lang"), "text")
    found = labelled.select("lang").distinct().limit(max_languages + 1).collect()
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    languages = sorted(r["lang"] for r in found)
    number = {name: i for i, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(number) * BUCKETS, np.int64)
        for batch in slices(batches):
            texts = batch["text"].to_pylist()
            language = np.array([number[x] for x in batch["lang"].to_pylist()], np.int64)
            for piece in chunks(texts):
                bucket, owner = trigrams(texts[piece])
                total += np.bincount(language[piece][owner] * BUCKETS + bucket, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    rows = labelled.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(languages) * BUCKETS)
    counts[rows["at"].to_numpy()] = rows["n"].to_numpy()
    return TrigramModel(languages, counts.reshape(len(languages), BUCKETS))


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)


def declared_of(page: Column) -> Column:
    """The primary subtag of the language that a page's markup declares, '' if none."""
    text = F.coalesce(page, F.lit(""))
    root = F.regexp_extract(text, r"""(?i)<html\b[^>]*?\s(?:xml:)?lang\s*=\s*["']?([a-z]{2,3})\b""", 1)
    meta = F.regexp_extract(text, r"""(?i)<meta\b[^>]*content-language["']?[^>]*?\scontent\s*=\s*["']?([a-z]{2,3})\b""", 1)
    return F.lower(F.when(root != "", root).otherwise(meta))


def _counts_by(votes: DataFrame, key: str, languages: int) -> DataFrame:
    """(key, n): pages of each language by the key's value."""
    each = [F.count(F.when(F.col("vote") == k, 1)).cast("double") for k in range(languages)]
    return votes.groupBy(key).agg(F.array(*each).alias(f"{key}_n"))


def _normal(values: Column) -> Column:
    """Probabilities from unnormalised logs."""
    shifted = F.transform(values, lambda x: F.exp(x - F.array_max(values)))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b))


def _smoothed(pages: DataFrame, key: str, above: Column, index: Column, count, own, strength: float) -> DataFrame:
    """With ``key``_prior: the key's counts without the page's own, smoothed towards ``above``."""
    counted = F.transform(
        index, lambda i: F.when(F.col(key) == "", 0.0).otherwise(F.greatest(count(key, i) - own(i), F.lit(0.0)))
    )
    pages = pages.withColumn(f"{key}_less", counted)
    total = F.aggregate(f"{key}_less", F.lit(0.0), lambda a, b: a + b)
    shares = F.zip_with(f"{key}_less", above, lambda x, p: (x + strength * p) / (total + strength))
    return pages.withColumn(f"{key}_prior", shares)


def identify(
    pages: DataFrame,
    model: TrigramModel,
    effective_grams: float = EFFECTIVE_GRAMS,
    host_strength: float = 5.0,
    evidence_strength: float = 2.0,
) -> DataFrame:
    """(page_id, lang, probability, text_lang, declared, suffix, host) of every page (page_id, url, html).

    ``host_strength`` pages' worth of the domain's shares smooth a host's, and of all pages' shares a domain's. A language's
    shares of declared languages and suffixes are smoothed by ``evidence_strength`` pages, of declared ones half on its own code.
    A page without a host, suffix or declaration has no evidence from it (the prior is then all pages'); one without text is
    decided by the rest. Ties go to the first language by name. Every row has a row, null and repeated ids too; without
    languages lang is null. Other columns are not read.
    """
    languages = model.languages
    k = len(languages)
    shared = pages.sparkSession.sparkContext.broadcast(model)
    narrow = pages.select(
        "page_id", "html", host_of(F.col("url")).alias("host"), declared_of(F.col("html")).alias("declared")
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [visible_text(page) for page in batch["html"].to_pylist()]
            logs = shared.value.likelihoods(texts, effective_grams)
            has_text = np.array([bool(t.strip()) for t in texts], bool)
            vote = np.where(has_text, logs.argmax(1), -1) if k else np.full(len(texts), -1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["page_id"].cast(pa.int64()),
                    batch["host"],
                    batch["declared"],
                    pa.array(list(logs), pa.list_(pa.float64())),
                    pa.array(vote, pa.int32()),
                ],
                names=["page_id", "host", "declared", "text", "vote"],
            )

    schema = "page_id long, host string, declared string, text array<double>, vote int"
    read_pages = stage(narrow.mapInArrow(read, schema), "pages")
    # An address of digits has no suffix that says anything.
    named = F.col("host").rlike(r"\.[a-z][a-z0-9-]+$")
    seen = read_pages.withColumn("suffix", F.when(named, F.substring_index("host", ".", -1)).otherwise("")).withColumn(
        "domain", F.when(named, F.substring_index("host", ".", -2)).otherwise(F.col("host"))
    )
    if not k:
        return seen.select(
            "page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"),
            F.lit(None).cast("string").alias("text_lang"), "declared", "suffix", "host",
        )
    votes = seen.where("vote >= 0")
    totals = {r["vote"]: r["count"] for r in votes.groupBy("vote").count().collect()}
    pages_of = np.array([totals.get(i, 0) for i in range(k)], float)
    shares = (pages_of + 1) / (pages_of.sum() + k)

    out = seen
    for key in ("host", "domain", "declared", "suffix"):
        out = out.join(_counts_by(votes.where(F.col(key) != ""), key, k), key, "left")
    index = F.sequence(F.lit(0), F.lit(k - 1))

    def own(i: Column) -> Column:
        return F.when(F.col("vote") == i, 1.0).otherwise(0.0)

    def count(key: str, i: Column) -> Column:
        return F.coalesce(F.get(F.col(f"{key}_n"), i), F.lit(0.0))

    def constant(values: np.ndarray) -> Column:
        return F.array(*[F.lit(float(v)) for v in values])

    # The host prior: all pages, then the domain, then the host, without the page itself.
    prior = constant(shares)
    for key in ("domain", "host"):
        out = _smoothed(out, key, prior, index, count, own, host_strength)
        prior = F.col(f"{key}_prior")

    # Evidence: shares of the declared code and the suffix among each language's pages.
    codes = F.array(*[F.lit(name) for name in languages])

    def evidence(key: str, base) -> Column:
        def of(i: Column) -> Column:
            given = count(key, i) - own(i) + evidence_strength * base(i)
            return F.log(F.greatest(given, F.lit(1e-6)) / (F.get(constant(pages_of), i) + evidence_strength))

        return F.when(F.col(key) == "", F.transform(index, lambda i: F.lit(0.0))).otherwise(F.transform(index, of))

    out = out.withColumn(
        "declared_log",
        evidence("declared", lambda i: F.when(F.get(codes, i) == F.col("declared"), 0.5).otherwise(0.5 / max(1, k))),
    ).withColumn("suffix_log", evidence("suffix", lambda i: F.lit(0.1)))
    logs = F.zip_with("text", "declared_log", lambda a, b: a + b)
    logs = F.zip_with(logs, "suffix_log", lambda a, b: a + b)
    logs = F.zip_with(logs, "host_prior", lambda a, b: a + F.log(b))
    out = out.withColumn("posterior", _normal(logs))
    best = F.array_position("posterior", F.array_max("posterior")).cast("int") - 1
    return out.select(
        "page_id",
        F.get(codes, best).alias("lang"),
        F.array_max("posterior").alias("probability"),
        F.when(F.col("vote") >= 0, F.get(codes, F.col("vote"))).alias("text_lang"),
        "declared",
        "suffix",
        "host",
    )
