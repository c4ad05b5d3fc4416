"""Building blocks of the SQL twins, as lists of common table expressions.

They state what an operator computes in its plainest form: per-pair distances, full L1 vectors, recursive steps
written out level by level.
"""

from __future__ import annotations

K = 4
LEVELS = 2
MIN_SAMPLES = 20
DIM = 64

PICTURES = (
    "pics AS (SELECT vec_id // 5 AS doc_id, CAST(vec_id % 5 AS INTEGER) AS pos, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
)


def with_ctes(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def fraction(text: str) -> str:
    """The md5 of a text as a number in [0, 1)."""
    return f"(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) / 4503599627370496.0)"


def tokens(table: str, keys: str, unit: str = "word") -> str:
    """(keys, w): the words of ``text``, or the 3-grams of its words."""
    words = f"SELECT {keys}, unnest(string_split_regex(lower(text), '[ \\n\\r\\t]+')) AS w FROM {table}"
    if unit == "word":
        return f"SELECT {keys}, w FROM ({words}) WHERE w <> ''"
    starts = "unnest(range(1, greatest(length(w) - 2, 1) + 1))"
    return f"SELECT {keys}, substr(w, i, 3) AS w FROM (SELECT {keys}, w, {starts} AS i FROM ({words}) WHERE w <> '')"


def sparse_text(name: str, table: str, keys: str, unit: str = "word") -> list[str]:
    """``name`` (keys, bucket, w): L2-normalised counts of hashed tokens."""
    return [
        f"{name}_tokens AS ({tokens(table, keys, unit)})",
        f"{name}_counts AS (SELECT {keys}, CAST(CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {DIM} AS INTEGER) AS bucket,"
        f" count(*) AS n FROM {name}_tokens GROUP BY ALL)",
        f"{name} AS (SELECT {keys}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {keys})) AS w FROM {name}_counts)",
    ]


def dense_text(name: str, table: str, keys: str, renamed: str) -> list[str]:
    """``name`` (renamed keys, v): the same as vectors of single precision."""
    return [
        *sparse_text(f"{name}_sparse", table, keys),
        f"{name}_grid AS (SELECT {keys}, unnest(range({DIM})) AS bucket FROM {table})",
        f"{name} AS (SELECT {renamed}, list(CAST(CAST(coalesce(w, 0) AS FLOAT) AS DOUBLE) ORDER BY bucket) AS v"
        f" FROM {name}_grid LEFT JOIN {name}_sparse USING ({keys}, bucket) GROUP BY {keys})",
    ]


CAPTIONS = dense_text("caps", "conversations", "conv_id, turn", "conv_id AS doc_id, CAST(turn AS INTEGER) AS pos")
TEST_CAPTIONS = dense_text("tests", "benchmark", "item_id", "item_id AS query_id, 0 AS pos")


def nearest(rows: str, centres: str, keys: str, centre: str = "c", vector: str = "v") -> str:
    """Per row the cluster of the nearest centre of its node, ties to the lower cluster."""
    return (
        f"SELECT {keys}, arg_min(cluster, (list_distance({vector}, {centre}), cluster)) AS cluster"
        f" FROM {rows} JOIN {centres} USING (term_id) GROUP BY {keys}"
    )


def seeds(rows: str, k: int, salt: str = "seed") -> str:
    place = f"row_number() OVER (PARTITION BY term_id ORDER BY md5('{salt}:' || term_id || ':' || doc_id || ':' || pos), doc_id, pos)"
    return f"SELECT term_id, CAST({place} - 1 AS INTEGER) AS cluster, v AS c FROM {rows} QUALIFY {place} <= {k}"


def means(labelled: str) -> str:
    parts = f"SELECT term_id, cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM {labelled}"
    mean = f"SELECT term_id, cluster, i, CAST(CAST(avg(x) AS FLOAT) AS DOUBLE) AS m FROM ({parts}) GROUP BY ALL"
    return f"SELECT term_id, cluster, list(m ORDER BY i) AS c FROM ({mean}) GROUP BY term_id, cluster"


def split(rows: str, name: str, k: int = K) -> list[str]:
    """Split all nodes of ``rows`` (term_id, doc_id, pos, v) after one round of means.

    ``<name>_means`` has the centres, ``<name>`` the rows at their children.
    """
    labelled = f"SELECT r.*, n.cluster FROM {rows} r JOIN ({{}}) n USING (term_id, doc_id, pos)"
    keys = "term_id, doc_id, pos"
    return [
        f"{name}_seeds AS ({seeds(rows, k)})",
        f"{name}_first AS ({labelled.format(nearest(rows, name + '_seeds', keys))})",
        f"{name}_means AS ({means(name + '_first')})",
        f"{name}_last AS ({labelled.format(nearest(rows, name + '_means', keys))})",
        f"{name} AS (SELECT term_id || '.' || cluster AS term_id, doc_id, pos, v FROM {name}_last)",
    ]


def tree(features: str, name: str = "tree", k: int = K, levels: int = LEVELS, min_samples: int = MIN_SAMPLES) -> list[str]:
    """``<name>_leaves`` (term_id, doc_id, pos, v) and ``<name>_nodes`` (term_id, parent_id, depth, c, n_features)."""
    ctes = [f"{name}_l0 AS (SELECT '0' AS term_id, doc_id, pos, v FROM {features})"]
    leaves = []
    nodes = [
        f"SELECT '0' AS term_id, CAST(NULL AS VARCHAR) AS parent_id, 0 AS depth, list_resize(CAST([] AS DOUBLE[]), {DIM}, 0.0) AS c,"
        f" (SELECT count(*) FROM {features}) AS n_features"
    ]
    for d in range(levels):
        rows, below = f"{name}_l{d}", f"{name}_l{d + 1}"
        big = f"(SELECT term_id FROM {rows} GROUP BY term_id HAVING count(*) >= {min_samples})"
        ctes.append(f"{name}_open{d} AS (SELECT * FROM {rows} WHERE term_id IN {big})")
        leaves.append(f"SELECT * FROM {rows} WHERE term_id NOT IN {big}")
        ctes += split(f"{name}_open{d}", below, k)
        nodes.append(
            f"SELECT m.term_id || '.' || m.cluster AS term_id, m.term_id AS parent_id, {d + 1} AS depth, m.c, s.n AS n_features"
            f" FROM {below}_means m JOIN (SELECT term_id, count(*) AS n FROM {below} GROUP BY term_id) s"
            f" ON s.term_id = m.term_id || '.' || m.cluster"
        )
    leaves.append(f"SELECT * FROM {name}_l{levels}")
    ctes.append(f"{name}_leaves AS ({' UNION ALL '.join(leaves)})")
    ctes.append(f"{name}_nodes AS ({' UNION ALL '.join(nodes)})")
    return ctes


def descend(features: str, key: str, nodes: str, name: str, levels: int = LEVELS) -> list[str]:
    """``name`` (key, pos, term_id): the leaf of each feature, one step per level."""
    keys = f"{key}, pos"
    ctes = [f"{name}_0 AS (SELECT {keys}, v, '0' AS term_id FROM {features})"]
    for d in range(levels):
        ctes.append(
            f"{name}_{d + 1} AS (SELECT {keys}, any_value(f.v) AS v,"
            f" coalesce(arg_min(n.term_id, (list_distance(f.v, n.c), n.term_id)) FILTER (n.term_id IS NOT NULL), any_value(f.term_id)) AS term_id"
            f" FROM {name}_{d} f LEFT JOIN {nodes} n ON n.parent_id = f.term_id GROUP BY {keys})"
        )
    ctes.append(f"{name} AS (SELECT {keys}, term_id FROM {name}_{levels})")
    return ctes


def path_counts(leaves: str, key: str, tf: str) -> str:
    """Per (term, key) the number of features below the term, by comparing path prefixes."""
    steps = "unnest(range(1, length(term_id) - length(replace(term_id, '.', '')) + 2))"
    prefix = "array_to_string(string_split(leaf, '.')[1:i], '.')"
    opened = f"SELECT {key}, term_id AS leaf, {steps} AS i FROM {leaves}"
    return f"SELECT {prefix} AS term_id, {key}, count(*) AS {tf} FROM ({opened}) GROUP BY ALL"


def postings(leaves: str, name: str = "post") -> list[str]:
    """``<name>`` (term_id, doc_id, tf) and ``<name>_stats`` (term_id, df, total_tf)."""
    return [
        f"{name} AS ({path_counts(leaves, 'doc_id', 'tf')})",
        f"{name}_stats AS (SELECT term_id, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total_tf FROM {name} GROUP BY term_id)",
    ]


def weights(query_leaves: str, docs: str, name: str = "w", stats: str = "post_stats") -> list[str]:
    """``<name>`` (query_id, term_id, query_tf, df, total_tf, idf, q_weight)."""
    return [
        f"{name}_tf AS ({path_counts(query_leaves, 'query_id', 'query_tf')})",
        f"{name}_idf AS (SELECT *, ln((1 + (SELECT count(DISTINCT doc_id) FROM {docs})) / (1 + df)) AS idf FROM {stats})",
        f"{name} AS (SELECT query_id, term_id, query_tf, df, total_tf, idf, query_tf / (query_tf + total_tf) * idf AS q_weight"
        f" FROM {name}_tf JOIN {name}_idf USING (term_id))",
    ]


def ranking(
    n: int, threshold: float, name: str = "hits", weights: str = "w", postings: str = "post", exclude_self: bool = False
) -> list[str]:
    """``<name>`` (query_id, rank, doc_id, distance) by the full L1 distance over all kept terms of the query."""
    skip = "WHERE doc_id <> query_id" if exclude_self else ""
    return [
        f"{name}_kept AS (SELECT * FROM {weights} WHERE q_weight >= {threshold})",
        f"{name}_q AS (SELECT query_id, term_id, q_weight / sum(q_weight) OVER (PARTITION BY query_id) AS qw FROM {name}_kept)",
        f"{name}_raw AS (SELECT query_id, term_id, doc_id, tf / (query_tf + total_tf) * idf AS dw"
        f" FROM {name}_kept JOIN {postings} USING (term_id))",
        f"{name}_d AS (SELECT query_id, term_id, doc_id, dw / sum(dw) OVER (PARTITION BY query_id, doc_id) AS dw FROM {name}_raw)",
        f"{name}_pairs AS (SELECT DISTINCT query_id, doc_id FROM {name}_raw)",
        f"{name}_dist AS (SELECT p.query_id, p.doc_id, round(sum(abs(q.qw - coalesce(d.dw, 0))), 9) AS distance"
        f" FROM {name}_pairs p JOIN {name}_q q USING (query_id)"
        f" LEFT JOIN {name}_d d ON d.query_id = p.query_id AND d.doc_id = p.doc_id AND d.term_id = q.term_id"
        f" GROUP BY p.query_id, p.doc_id)",
        f"{name}_ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS INTEGER)"
        f" AS rank, doc_id, distance FROM {name}_dist {skip})",
        f"{name} AS (SELECT * FROM {name}_ranked WHERE rank <= {n})",
    ]


def exact(captions: str, queries: str, n: int, name: str = "best") -> list[str]:
    """``<name>`` (query_id, rank, doc_id, similarity) over all pairs."""
    cosine = "coalesce(list_cosine_similarity(q.v, c.v), 0)"
    return [
        f"{name}_all AS (SELECT query_id, doc_id, round(greatest(max({cosine}), 0), 9) AS similarity"
        f" FROM {captions} c, {queries} q GROUP BY query_id, doc_id)",
        f"{name}_ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS INTEGER)"
        f" AS rank, doc_id, similarity FROM {name}_all)",
        f"{name} AS (SELECT * FROM {name}_ranked WHERE rank <= {n})",
    ]
