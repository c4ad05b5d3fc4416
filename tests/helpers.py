"""Small inputs, and plain-Python versions of the core formulas to compare with."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

FEATURE = "doc_id long, pos int, vec array<float>"


def random_features(spark, docs=60, per_doc=5, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    n = docs * per_doc
    vectors = (centres[rng.integers(6, size=n)] + 0.3 * rng.normal(size=(n, dim))).astype(np.float32)
    table = pa.table(
        {
            "doc_id": pa.array(np.repeat(np.arange(docs), per_doc)),
            "pos": pa.array(np.tile(np.arange(per_doc, dtype=np.int32), docs)),
            "vec": pa.array(list(vectors), pa.list_(pa.float32())),
        }
    )
    return spark.createDataFrame(table)


def path(term):
    parts = term.split(".")
    return [".".join(parts[: i + 1]) for i in range(len(parts))]


def brute_force_search(query_leaves, postings, docs_count, n, threshold):
    """{query: [(doc, distance)]} from {query: [leaf]} and {(term, doc): tf}, with full dense vectors."""
    df, total, docs_of = Counter(), Counter(), defaultdict(dict)
    for (term, doc), tf in postings.items():
        df[term] += 1
        total[term] += tf
        docs_of[term][doc] = tf
    out = {}
    for query, leaves in query_leaves.items():
        tfs = Counter(t for leaf in leaves for t in path(leaf))
        vectors = defaultdict(dict)
        for term, tf in tfs.items():
            idf = math.log((1 + docs_count) / (1 + df[term]))
            weight = tf / (tf + total[term]) * idf
            if weight < threshold:
                continue
            vectors["query"][term] = weight
            for doc, doc_tf in docs_of[term].items():
                vectors[doc][term] = doc_tf / (tf + total[term]) * idf
        asked = vectors.pop("query", {})
        q_norm = sum(asked.values())
        scored = []
        for doc, weights in vectors.items():
            norm = sum(weights.values())
            scored.append((round(sum(abs(w / q_norm - weights.get(t, 0) / norm) for t, w in asked.items()), 9), doc))
        out[query] = [(doc, distance) for distance, doc in sorted(scored)[:n]]
    return out
