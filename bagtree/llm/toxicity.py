"""Toxicity: a linear classifier whose scores may not change when identity terms are swapped.

Features are the distinct words of a document and the leading bytes of its longer words, so inflected forms share some. Those
whose presence goes with the label (likelihood-ratio test over the training rows) enter a logistic regression. For each
training row that names a group, copies are made in which the terms are swapped for the next ones of their kind; the squared
change of the logit is part of the loss, so that what is left of a term's weight is what its kind has in common, and a neutral
mention of a group costs no false alarm. (Counterfactual logit pairing, Garg et al. 2019.)

The fit takes at most ``sample_rows`` labelled rows, drawn by a hash of doc_id, and
at most ``max_features`` features. Scoring is one pass over the documents, map only.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagtree.llm.words import Words, chunks, mix, slices, words_of
from bagtree.sources.scratch import stage, unstage

SAMPLE_ROWS = 40_000
MAX_FEATURES = 4096
PREFIXES = (4, 5, 6, 8)

# Words that name a group, by kind; only words of one kind are swapped.
IDENTITY_TERMS: dict[str, tuple[str, ...]] = {
    "religion": ("christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "catholic", "protestant", "atheist"),
    "religions": ("christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "catholics", "protestants", "atheists"),
    "gender": ("male", "female", "transgender", "nonbinary"),
    "people": ("men", "women"),
    "person": ("man", "woman"),
    "orientation": ("straight", "gay", "lesbian", "bisexual", "queer", "heterosexual", "homosexual"),
    "race": ("white", "black", "asian", "latino", "african", "european", "arab", "indigenous"),
    "nationality": ("american", "mexican", "chinese", "indian", "german", "french", "spanish", "russian", "turkish"),
    "age": ("young", "old", "elderly"),
    "ability": ("blind", "deaf", "disabled", "autistic"),
    "religion_de": ("christ", "muslim", "jude", "hindu", "buddhist", "atheist"),
    "people_de": ("männer", "frauen"),
    "religion_fr": ("chrétien", "musulman", "juif", "hindou", "bouddhiste", "athée"),
    "people_fr": ("hommes", "femmes"),
    "religion_es": ("cristiano", "musulmán", "judío", "hindú", "budista", "ateo"),
    "people_es": ("hombres", "mujeres"),
}


def _feature_list(words: Words, prefixes: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word number): each word and its prefixes, told apart by their length."""
    features, at = [words.hashes], [np.arange(len(words.hashes))]
    for size in prefixes:
        hashes, longer = words.prefixes(size)
        features.append(mix(hashes + np.uint64(size)))
        at.append(longer)
    return np.concatenate(features), np.concatenate(at)


def _distinct(features: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((features, owner))
    features, owner = features[order], owner[order]
    new = np.ones(len(features), bool)
    new[1:] = (features[1:] != features[:-1]) | (owner[1:] != owner[:-1])
    return features[new], owner[new]


class _Known:
    """Numbers of the features that are in a sorted array."""

    def __init__(self, features: np.ndarray):
        self.features = features
        self.table = np.zeros(1 << 16, bool)
        self.table[(features >> np.uint64(48)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the hashes, their numbers)."""
        if not len(self.features):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        maybe = np.flatnonzero(self.table[(hashes >> np.uint64(48)).astype(np.int64)])
        number = np.minimum(np.searchsorted(self.features, hashes[maybe]), len(self.features) - 1)
        good = self.features[number] == hashes[maybe]
        return maybe[good], number[good]


def _rows_of(texts: list[str | None], known: _Known, prefixes: Sequence[int]) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(slice, text in it, number): the known features of each text, each once."""
    for piece in chunks(texts):
        words = words_of(texts[piece])
        hashes, at = _feature_list(words, prefixes)
        which, number = known.find(hashes)
        numbers, owner = _distinct(number, words.owners()[at[which]])
        yield piece, owner, numbers


@dataclass
class Swaps:
    """For each identity term its word hash and the next term of its kind."""

    terms: np.ndarray
    following: list[str]

    @staticmethod
    def of(kinds: Mapping[str, Sequence[str]]) -> Swaps:
        after: dict[str, str] = {}
        for terms in kinds.values():
            for term, other in zip(terms, [*terms[1:], *terms[:1]]):
                after.setdefault(term.lower(), other.lower())
        names = list(after)
        hashes = np.array([words_of([name]).hashes[0] for name in names], np.uint64)
        order = np.argsort(hashes)
        return Swaps(hashes[order], [after[names[i]] for i in order])

    def swapped(self, text: str) -> str | None:
        """The text, lower-cased, with every identity term replaced; None if it has none."""
        words = words_of([text])
        if not len(self.terms) or not len(words.hashes):
            return None
        at = np.minimum(np.searchsorted(self.terms, words.hashes), len(self.terms) - 1)
        hit = np.flatnonzero(self.terms[at] == words.hashes)
        if not len(hit):
            return None
        data, out, done = words.data.tobytes(), [], 0
        for n in hit:
            out += [data[done : words.start[n]], self.following[at[n]].encode()]
            done = words.end[n]
        return b"".join([*out, data[done:-1]]).decode("utf-8", "replace")


@dataclass
class ToxicityModel:
    features: np.ndarray  # sorted
    weights: np.ndarray
    bias: float
    prefixes: tuple[int, ...]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The probability of label 1; a text without known features, as an empty or null one, gets that of the bias."""
        logits = np.full(len(texts), self.bias)
        for piece, owner, number in _rows_of(texts, _Known(self.features), self.prefixes):
            logits[piece] += np.bincount(owner, self.weights[number], piece.stop - piece.start)
        return 1 / (1 + np.exp(-np.clip(logits, -500, 500)))

    def score(self, documents: DataFrame) -> DataFrame:
        """(doc_id, score) of every row (doc_id, text)."""
        shared = documents.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                scores = shared.value.scores(batch["text"].to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].cast(pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "score"]
                )

        return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")

    def accepted(self, documents: DataFrame, threshold: float = 0.5) -> DataFrame:
        """The rows that score below ``threshold``, with all their columns."""
        shared = documents.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                yield batch.filter(pa.array(shared.value.scores(batch["text"].to_pylist()) < threshold))

        return documents.mapInArrow(run, documents.schema)


def fit_weights(
    rows: np.ndarray, columns: np.ndarray, labels: np.ndarray, swap_rows, swap_columns, swap_signs, width: int,
    ridge: float, fairness: float, steps: int,
) -> tuple[np.ndarray, float]:
    """Logistic regression on presence features by accelerated gradient descent.

    Loss: mean log loss + ridge / 2 |w|^2 + fairness / 2 * mean squared logit change of the swapped copies, which are given as entries
    (copy, feature, +1 gained or -1 lost).
    """
    n, copies = len(labels), int(swap_rows.max()) + 1 if len(swap_rows) else 0
    weights, bias = np.zeros(width), float(np.log((labels.sum() + 0.5) / (n - labels.sum() + 0.5)))
    degree = np.bincount(rows, minlength=n).astype(float)
    # Each coordinate's own bound on the curvature: its rows, weighted by how many features those have.
    curve = np.bincount(columns, np.maximum(degree, 1)[rows], width) / (4 * n) + ridge
    if copies:
        changed = np.bincount(swap_rows, minlength=copies).astype(float)
        curve += fairness * np.bincount(swap_columns, changed[swap_rows], width) / copies
    curve_bias = (degree.max(initial=0) + 1) / 4
    at, at_bias, momentum = weights.copy(), bias, 1.0
    for _ in range(steps):
        logits = at_bias + np.bincount(rows, at[columns], n)
        error = 1 / (1 + np.exp(-np.clip(logits, -500, 500))) - labels
        gradient = np.bincount(columns, error[rows], width) / n + ridge * at
        if copies:
            change = np.bincount(swap_rows, swap_signs * at[swap_columns], copies)
            gradient += fairness * np.bincount(swap_columns, swap_signs * change[swap_rows], width) / copies
        if max(np.abs(gradient).max(initial=0.0), abs(error.mean())) < 1e-8:
            break
        new, new_bias = at - gradient / curve, at_bias - error.mean() / curve_bias
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        push = (momentum - 1) / following
        at, at_bias = new + push * (new - weights), new_bias + push * (new_bias - bias)
        weights, bias, momentum = new, new_bias, following
    return weights, bias


def fit(
    documents: DataFrame,
    labels: DataFrame,
    identity_terms: Mapping[str, Sequence[str]] | None = None,
    sample_rows: int = SAMPLE_ROWS,
    max_features: int = MAX_FEATURES,
    prefixes: tuple[int, ...] = PREFIXES,
    min_ratio: float = 20.0,
    ridge: float = 1e-5,
    fairness: float = 1.0,
    steps: int = 600,
) -> ToxicityModel:
    """Learn from the rows of ``documents`` (doc_id, text) that ``labels`` (doc_id, toxic) marks.

    Rows without an id or a label are not learned from; of several labels of an id the highest counts. With no labelled rows, or only one
    label, the model has no features and its bias is the (smoothed) rate of the label, so it says 0 where nothing is known.
    """
    swaps = Swaps.of(IDENTITY_TERMS if identity_terms is None else identity_terms)
    marked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    # Bounded by sample_rows.
    sample = stage(
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(marked), "doc_id")
        .select("toxic", "text"),
        "labelled",
    )
    counts = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    if not toxic or not clean:
        unstage(sample)
        return ToxicityModel(np.empty(0, np.uint64), np.empty(0), float(np.log((toxic + 0.1) / (clean + 0.5))), prefixes)

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, label = batch["text"].to_pylist(), batch["toxic"].to_numpy()
            for piece in chunks(texts):
                words = words_of(texts[piece])
                hashes, at = _feature_list(words, prefixes)
                features, owner = _distinct(hashes, words.owners()[at])
                values, number = np.unique(features, return_inverse=True)
                is_toxic = label[piece][owner] > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(values.view(np.int64)),
                        pa.array(np.bincount(number, is_toxic, len(values)).astype(np.int64)),
                        pa.array(np.bincount(number, ~is_toxic, len(values)).astype(np.int64)),
                    ],
                    names=["feature", "toxic", "clean"],
                )

    seen = sample.mapInArrow(presence, "feature long, toxic long, clean long").groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    )
    # Only a feature in some rows can pass the test; the ratio itself is computed over what is left.
    ratio = _ratio_column(F.col("toxic"), F.col("clean"), toxic, clean)
    best = seen.where("toxic + clean >= 5").withColumn("ratio", ratio).where(F.col("ratio") >= min_ratio)
    best = best.orderBy(F.desc("ratio"), "feature").limit(max_features).collect()
    features = np.sort(np.array([r["feature"] for r in best], np.int64).view(np.uint64))
    shared = documents.sparkSession.sparkContext.broadcast((features, swaps))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, swaps = shared.value
        known = _Known(features)
        for batch in slices(batches):
            texts, label = batch["text"].to_pylist(), batch["toxic"].to_pylist()
            present = _sets(texts, known, prefixes)
            copies = [swaps.swapped(t or "") for t in texts]
            mates = _sets([c for c in copies if c is not None], known, prefixes)
            mate = iter(mates)
            other = [None if c is None else next(mate) for c in copies]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(label, pa.int32()),
                    pa.array(present, pa.list_(pa.int32())),
                    pa.array(other, pa.list_(pa.int32())),
                ],
                names=["toxic", "present", "swapped"],
            )

    table = sample.mapInArrow(entries, "toxic int, present array<int>, swapped array<int>").toArrow()
    shared.destroy()
    unstage(sample)
    y = table["toxic"].to_numpy().astype(float)
    row = np.repeat(np.arange(len(y)), pc.list_value_length(table["present"]).to_numpy())
    column = pc.list_flatten(table["present"]).to_numpy().astype(np.int64)
    copy, feature, sign = [], [], []
    mates = table.filter(table["swapped"].is_valid())
    for n, (present, other) in enumerate(zip(mates["present"].to_pylist(), mates["swapped"].to_pylist())):
        before, after = set(present), set(other)
        for change, value in ((after - before, 1.0), (before - after, -1.0)):
            copy += [n] * len(change)
            feature += sorted(change)
            sign += [value] * len(change)
    weights, bias = fit_weights(
        row, column, y, np.array(copy, np.int64), np.array(feature, np.int64), np.array(sign), len(features), ridge, fairness, steps
    )
    return ToxicityModel(features, weights, bias, prefixes)


def _sets(texts: list[str | None], known: _Known, prefixes: Sequence[int]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for piece, owner, numbers in _rows_of(texts, known, prefixes):
        out += np.split(numbers.astype(np.int32), np.searchsorted(owner, np.arange(1, piece.stop - piece.start)))
    return out


def _ratio_column(with_toxic: Column, with_clean: Column, toxic: int, clean: int) -> Column:
    """G of the two-by-two table of presence and label."""
    total = float(toxic + clean)
    present = with_toxic + with_clean
    absent = F.lit(total) - present

    def part(observed: Column, expected: Column) -> Column:
        return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)

    return 2 * (
        part(with_toxic, present * toxic / total)
        + part(with_clean, present * clean / total)
        + part(F.lit(float(toxic)) - with_toxic, absent * toxic / total)
        + part(F.lit(float(clean)) - with_clean, absent * clean / total)
    )


def held_out(doc_id: Column, parts: int = 5) -> Column:
    """crc32 of the id as text modulo ``parts`` is 0; rows without an id are held out."""
    remainder = F.crc32(doc_id.cast("string").cast("binary")) % parts
    return F.coalesce(remainder == 0, F.lit(True))
