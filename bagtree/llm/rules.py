"""Quality rules as a ledger of bits: texts are measured and judged once, policies are applied to the bits.

``ledger`` reads every text once and stores, per row, the measurements and one integer whose bit i says that rule i failed. A
policy is a version and the names of the rules it asks for, hence a mask: ``verdicts`` compares bits with masks, so a new policy never
reads a text again. ``judged`` draws the bits anew from stored measurements where a rule's limit has changed. ``ablations``
counts rows by their failed bits under the mask (at most one row per combination that occurs, summed before the exchange) and gets from
these counts what each rule rejects alone and what would be kept without it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagtree.llm.words import chunks, shingles_of, slices, words_of

# What separates words (space, tab, line feed, vertical tab, form feed, carriage return), symbols, window length.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_lines",
    "n_dup_lines",
    "n_repeat_words",
    "n_upper",
    "n_lower",
    "n_marks",
    "longest_word",
    "n_echoes",
)

_IN_WORD = np.array([chr(b) not in SPACES for b in range(256)])
_UPPER, _LOWER = bytes(range(ord("A"), ord("Z") + 1)), bytes(range(ord("a"), ord("z") + 1))


@dataclass(frozen=True)
class Rule:
    """``failed`` is true of measurements (columns by name) that break the rule. A bit never changes its meaning."""

    bit: int
    name: str
    failed: Callable[[Callable[[str], Column]], Column]


@dataclass(frozen=True)
class Policy:
    """A version and the rules that a row must pass to be kept."""

    version: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...]) -> int:
        known = {rule.name: rule.bit for rule in rules}
        missing = [name for name in self.rules if name not in known]
        if missing:
            raise ValueError(f"policy {self.version} asks for unknown rules {missing}")
        return sum(1 << known[name] for name in set(self.rules))


# All limits compare integers, so that every engine agrees.
RULES = (
    Rule(0, "few_words", lambda m: m("n_words") < 10),
    Rule(1, "repeated_windows", lambda m: 100 * m("n_repeat_words") > 20 * m("n_words")),
    Rule(2, "symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule(3, "repeated_lines", lambda m: (m("n_dup_lines") >= 2) & (100 * m("n_dup_lines") > 30 * m("n_lines"))),
    Rule(4, "short_words", lambda m: m("word_chars") < 2 * m("n_words")),
    Rule(5, "long_words", lambda m: m("word_chars") > 15 * m("n_words")),
    Rule(6, "upper_case", lambda m: 100 * m("n_upper") > 40 * (m("n_upper") + m("n_lower"))),
    Rule(7, "shouting", lambda m: 100 * m("n_marks") > 30 * m("n_words")),
    Rule(8, "endless_word", lambda m: m("longest_word") > 1000),
    Rule(9, "echoes", lambda m: 100 * m("n_echoes") > 30 * m("n_words")),
)

BASE = Policy("base", ("few_words", "repeated_windows"))
POLICIES = {
    policy.version: policy
    for policy in (
        BASE,
        Policy("1", (*BASE.rules, "symbols", "repeated_lines")),
        Policy("2", tuple(rule.name for rule in RULES)),
    )
}


def _measured(texts: list[str | None]) -> dict[str, np.ndarray]:
    """All measurements of some texts; a null text is one without a character."""
    words = words_of(texts, _IN_WORD, keep_case=True)
    count = np.diff(words.first)
    out = {name: np.zeros(len(texts), np.int64) for name in MEASURES}
    out["n_words"] = count
    for i, text in enumerate(texts):
        if not text:
            continue
        out["word_chars"][i] = len(text) - sum(map(text.count, SPACES))
        out["n_symbols"][i] = sum(map(text.count, SYMBOLS))
        out["n_marks"][i] = text.count("!") + text.count("?")
        lines = [line for line in text.split("\n") if line.strip(SPACES)]
        out["n_lines"][i] = len(lines)
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
        data = text.encode("utf-8", "surrogatepass")
        out["n_upper"][i] = len(data) - len(data.translate(None, _UPPER))
        out["n_lower"][i] = len(data) - len(data.translate(None, _LOWER))
    some = np.flatnonzero(count)
    if len(some):
        # Bytes, not characters: this bounds what a single word may weigh.
        out["longest_word"][some] = np.maximum.reduceat(words.end - words.start, words.first[some])
    out["n_repeat_words"] = _repeat_words(words, count)
    owner = words.owners()
    echo = (words.hashes[1:] == words.hashes[:-1]) & (owner[1:] == owner[:-1])
    out["n_echoes"] = np.bincount(owner[1:][echo], minlength=len(texts))
    return out


def _repeat_words(words, count: np.ndarray) -> np.ndarray:
    """Words that lie in a window of WINDOW words found at least twice in their text."""
    hashes, owner = shingles_of(words, WINDOW)
    if not len(hashes):
        return np.zeros(len(count), np.int64)
    number = np.bincount(owner, minlength=len(count))
    at = words.first[owner] + np.arange(len(owner)) - (np.cumsum(number) - number)[owner]
    order = np.lexsort((hashes, owner))
    same = (hashes[order][1:] == hashes[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    twice = np.zeros(len(hashes), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words.hashes) + 1, np.int64)
    edge[at[twice]] += 1
    edge[at[twice] + WINDOW] -= 1  # a text with fewer words has one window, which is never found twice
    inside = np.concatenate([[0], np.cumsum(np.cumsum(edge)[:-1] > 0)])
    return inside[words.first[1:]] - inside[words.first[:-1]]


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, measurements): one row for each row of ``docs``, whose other columns play no part."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch["text"].to_pylist()
            for part in chunks(texts):
                found = _measured(texts[part])
                ids = batch["doc_id"].slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(found[name], pa.int64()) for name in MEASURES)], names=["doc_id", *MEASURES])

    schema = ", ".join([f"doc_id {key}", *(f"{name} long" for name in MEASURES)])
    return docs.select("doc_id", "text").mapInArrow(measure_batches, schema)


def judged(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measurements with ``failed``: bit i is set where rule i is broken."""
    if len({rule.bit for rule in rules}) < len(rules) or any(not 0 <= rule.bit < 63 for rule in rules):
        raise ValueError("every rule needs a bit of its own, from 0 to 62")
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(rule.failed(F.col), F.lit(1 << rule.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured.withColumn("failed", bits)


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, measurements, failed) of every whole text, one row per row of ``docs`` (doc_id, text).

    A null, empty or blank text has no words and all its measurements are 0, so it fails ``few_words`` alone. Equal rows get equal
    rows. A null doc_id stays null. Other columns of ``docs`` are left out, whatever their names. An empty table gives an
    empty ledger. Windows are compared by 64-bit hashes.
    """
    return judged(measure(docs), rules)


def passes(policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether a ledger row has none of the policy's bits."""
    return F.col("failed").bitwiseAND(F.lit(policy.mask(rules)).cast("long")) == 0


def verdicts(rows: DataFrame, policies: dict[str, Policy] | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows with ``kept``, a map from policy version to verdict."""
    chosen = POLICIES if policies is None else policies
    pairs = [x for policy in chosen.values() for x in (F.lit(policy.version), passes(policy, rules))]
    return rows.withColumn("kept", F.create_map(*pairs))


def ablations(rows: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., version, rule, n_rows, n_failed, n_only, n_kept, n_kept_without) for each rule of the policy.

    ``n_only`` rows fail this rule and no other of the policy; ``n_kept_without`` is what the policy keeps if the rule goes. The
    first aggregation has one row per combination of failed bits (and value of ``by``), the second works on these only.
    """
    mask = F.lit(policy.mask(rules)).cast("long")
    patterns = rows.groupBy(*by, F.col("failed").bitwiseAND(mask).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    own = [F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules if r.name in policy.rules]
    each = patterns.select(*by, "pattern", "n", F.explode(F.array(*own)).alias("of"))
    hit, rest = F.col("pattern").bitwiseAND(F.col("of.bit")) != 0, F.col("pattern").bitwiseAND(F.bitwise_not(F.col("of.bit")))
    total = lambda chosen: F.sum(F.when(chosen, F.col("n")).otherwise(0))
    return each.groupBy(*by, F.col("of.rule").alias("rule")).agg(
        F.lit(policy.version).alias("version"),
        F.sum("n").alias("n_rows"),
        total(hit).alias("n_failed"),
        total(hit & (rest == 0)).alias("n_only"),
        total(F.col("pattern") == 0).alias("n_kept"),
        total(rest == 0).alias("n_kept_without"),
    )


def fired(rows: DataFrame, rules: tuple[Rule, ...] = RULES, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., n_rows, any_failed, all_failed): names of the rules that some row, and that every row, of a group fails."""
    names = lambda bits: F.filter(
        F.array(*[F.when(F.col(bits).bitwiseAND(F.lit(1 << r.bit).cast("long")) != 0, F.lit(r.name)) for r in rules]), lambda x: x.isNotNull()
    )
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.bit_or("failed").alias("any"), F.bit_and("failed").alias("every"))
    return sums.select(*by, "n_rows", names("any").alias("any_failed"), names("every").alias("all_failed"))
