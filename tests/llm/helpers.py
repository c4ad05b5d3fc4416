"""Small tables with every kind of odd row, and plain versions to compare with."""

import random
import re
from collections import Counter

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, words, vocabulary=400):
    return " ".join(f"w{int(rng.paretovariate(0.7)) % vocabulary}" for _ in range(words))


def rows(seed=1, n=40):
    """Ordinary documents, near and equal copies, nulls in every column, empty and blank texts, a repeated row, a long text."""
    rng = random.Random(seed)
    out = [(i, prose(rng, rng.randint(5, 120)), rng.choice(["en", "de"]), f"s{i % 3}", 1) for i in range(n)]
    base = prose(rng, 200)
    for i in range(6):
        words = base.split()
        words[10 * i + 3] = f"changed{i}"
        out.append((1000 + i, " ".join(words), "en", "s0", 1))
    out += [(2000, base, "en", None, None), (2001, base, None, "s1", 1), (2001, base, None, "s1", 1)]
    out += [(3000, None, "en", "s1", 0), (3001, "", "en", "s2", 0), (3002, " \n\t ", None, None, 3), (3003, "...", "de", "s0", 3)]
    out += [(None, "a row without an id", "en", "s0", 5), (None, None, None, None, None), (-7, "Ünïcode ÄÖ 中文 ñandú", "es", "s1", 5)]
    out.append((4000, prose(rng, 20_000), "en", "s2", 100_000))
    return out


def documents(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, DOCUMENTS)


def clashing(frame, *names):
    """With more columns, named as the operators name their own."""
    for name in names:
        frame = frame.withColumn(name, frame["doc_id"].cast("string"))
    return frame


def shingles(text, size=5):
    words = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode())
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def weighted_jaccard(a, b):
    total = sum((a | b).values())
    return sum((a & b).values()) / total if total else 0.0
