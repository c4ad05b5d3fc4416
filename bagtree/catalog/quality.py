"""Exact search and retrieval quality of the text search."""

from __future__ import annotations

from pyspark.sql import functions as F

from bagtree.catalog import sql
from bagtree.catalog.data import THRESHOLD, caption_features, captions, pictures, test_captions
from bagtree.catalog.ingest import captioned_items
from bagtree.catalog.registry import query
from bagtree.catalog.searching import DEEP_HITS, TEXT_HITS, TWO_STEP, deep_search, feedback_queries
from bagtree.operators import evaluate as quality
from bagtree.operators import metric
from bagtree.operators.search import search
from bagtree.sources.captions import caption_counts
from bagtree.sources.scratch import stage

_EXACT = [*sql.CAPTIONS, *sql.TEST_CAPTIONS, *sql.exact("caps", "tests", 20)]
_RELEVANCE = [
    *TEXT_HITS,
    *sql.exact("caps", "tests", 20),
    """rel AS (SELECT query_id, rank, h.doc_id, a.similarity,
       CASE WHEN b.similarity <= 0 THEN 0 ELSE a.similarity / b.similarity END AS relevance
       FROM hits h JOIN best_all a USING (query_id, doc_id) JOIN best b USING (query_id, rank))""",
]
_LISTS = [
    *_RELEVANCE,
    "cuts AS (SELECT * FROM rel, (SELECT unnest([1, 5, 10, 20]) AS n) WHERE rank <= n)",
    """placed AS (SELECT *, row_number() OVER (PARTITION BY n, query_id ORDER BY relevance DESC, rank) AS best_rank FROM cuts)""",
    """lists AS (SELECT n, query_id, avg(relevance) AS "precision", sum(relevance / log2(rank + 1)) AS dcg,
       sum(relevance / log2(best_rank + 1)) AS idcg, sum(1 / log2(best_rank + 1)) AS full_dcg FROM placed GROUP BY n, query_id)""",
    "graded AS (SELECT *, CASE WHEN idcg = 0 THEN 0 ELSE dcg / idcg END AS ndcg, dcg / full_dcg AS ndcg_ideal FROM lists)",
]


def _exact(spark, sf_dir):
    return quality.exact_topk(caption_features(spark, sf_dir), test_captions(spark, sf_dir))


@query(sql.with_ctes(_EXACT, "SELECT query_id, rank, doc_id, round(similarity, 6) AS similarity FROM best"))
def exact_topk(spark, sf_dir):
    """The twenty items with the most similar caption, over all of them."""
    return _exact(spark, sf_dir).withColumn("similarity", F.round("similarity", 6))


@query(sql.with_ctes(_EXACT, "SELECT query_id, rank, doc_id, round(similarity, 6) AS similarity FROM best"))
def exact_topk_by_tree(spark, sf_dir):
    """The same as ``exact_topk``, through the caption tree: leaves that cannot hold an answer are passed over."""
    built = captions(spark, sf_dir)
    found = metric.exact_topk_by_tree(built.tree.assignments, built.index.nodes, test_captions(spark, sf_dir))
    return found.withColumn("similarity", F.round("similarity", 6))


@query(sql.with_ctes(_EXACT, "SELECT query_id, CAST(21 - rank AS INTEGER) AS rank, round(similarity, 6) AS relevance FROM best"))
def ideal_relevances(spark, sf_dir):
    """The best possible similarities, smallest first."""
    ideal = quality.ideal_relevances(caption_features(spark, sf_dir), test_captions(spark, sf_dir), order="asc")
    return ideal.withColumn("relevance", F.round("relevance", 6))


def _relevant(spark, sf_dir, results=None):
    built, queries = captions(spark, sf_dir), test_captions(spark, sf_dir)
    results = search(queries, built.index, quality.MAX_N, THRESHOLD) if results is None else results
    scored = quality.similarities(results, built.features, queries)
    ideal = quality.exact_topk(built.features, queries).withColumnRenamed("similarity", "relevance")
    return quality.relevances(scored, ideal)


@query(
    sql.with_ctes(
        _RELEVANCE,
        "SELECT query_id, rank, doc_id, round(similarity, 6) AS similarity, round(relevance, 6) AS relevance FROM rel",
    )
)
def relevance(spark, sf_dir):
    """Relevance of each result: its similarity relative to the best possible one at its rank."""
    return _relevant(spark, sf_dir).select(
        "query_id", "rank", "doc_id", F.round("similarity", 6).alias("similarity"), F.round("relevance", 6).alias("relevance")
    )


def _lists(spark, sf_dir):
    return quality.list_quality(quality.cut_to_each_n(_relevant(spark, sf_dir)), ["n", "query_id"])


@query(sql.with_ctes(_LISTS, 'SELECT n, query_id, round("precision", 6) AS "precision" FROM graded'))
def precision_at_n(spark, sf_dir):
    return _lists(spark, sf_dir).select("n", "query_id", F.round("precision", 6).alias("precision"))


@query(
    sql.with_ctes(
        _LISTS,
        """SELECT n, query_id, round(dcg, 6) AS dcg, round(idcg, 6) AS idcg, round(ndcg, 6) AS ndcg,
           round(ndcg_ideal, 6) AS ndcg_ideal FROM graded""",
    )
)
def ndcg_at_n(spark, sf_dir):
    measures = ("dcg", "idcg", "ndcg", "ndcg_ideal")
    return _lists(spark, sf_dir).select("n", "query_id", *[F.round(m, 6).alias(m) for m in measures])


@query(
    sql.with_ctes(
        _LISTS,
        """SELECT 'labeled_only' AS variant, n, round(sum("precision") / (SELECT count(*) FROM benchmark), 6) AS mean_precision,
           round(sum(ndcg) / (SELECT count(*) FROM benchmark), 6) AS mean_ndcg FROM graded GROUP BY n""",
    )
)
def evaluate_sweep(spark, sf_dir):
    """Mean precision and nDCG of the text search at 1, 5, 10 and 20."""
    relevant = _relevant(spark, sf_dir).withColumn("variant", F.lit("labeled_only"))
    means = quality.evaluate(relevant, test_captions(spark, sf_dir))
    return means.select(
        "variant", "n", F.round("mean_precision", 6).alias("mean_precision"), F.round("mean_ndcg", 6).alias("mean_ndcg")
    )


def _sweep_sql(variant, hits, name):
    """The sweep of one search, whose rows are in the CTE ``name``."""
    lists = [part.replace("hits h", f"{name} h") for part in _LISTS[len(TEXT_HITS) :]]
    means = f"""SELECT '{variant}' AS variant, n, round(sum("precision") / (SELECT count(*) FROM benchmark), 6) AS mean_precision,
           round(sum(ndcg) / (SELECT count(*) FROM benchmark), 6) AS mean_ndcg FROM graded GROUP BY n"""
    return f"SELECT * FROM ({sql.with_ctes([*hits, *lists], means)})"


@query(_sweep_sql("labeled_only", TEXT_HITS, "hits") + " UNION ALL " + _sweep_sql("all", TWO_STEP, "found"))
def evaluate_sweep_both(spark, sf_dir):
    """Mean precision and nDCG at 1, 5, 10 and 20 of the text search and of the two-step search."""
    built = pictures(spark, sf_dir)
    two_step = search(feedback_queries(spark, sf_dir), built.index, quality.MAX_N, THRESHOLD)
    relevant = _relevant(spark, sf_dir).withColumn("variant", F.lit("labeled_only"))
    both = relevant.unionByName(_relevant(spark, sf_dir, two_step).withColumn("variant", F.lit("all")))
    means = quality.evaluate(both, test_captions(spark, sf_dir))
    return means.select(
        "variant", "n", F.round("mean_precision", 6).alias("mean_precision"), F.round("mean_ndcg", 6).alias("mean_ndcg")
    )


def _recall_sql(hits):
    return sql.with_ctes(
        [*hits, *sql.exact("caps", "tests", 20), "ns AS (SELECT unnest([1, 5, 10, 20]) AS n)"],
        """SELECT n, round(count(h.doc_id) / count(*), 6) AS recall FROM ns JOIN best b ON b.rank <= n
           LEFT JOIN hits h ON h.query_id = b.query_id AND h.doc_id = b.doc_id AND h.rank <= n GROUP BY n""",
    )


@query(_recall_sql(TEXT_HITS))
def recall_vs_exact(spark, sf_dir):
    """Share of the exact first n that the tree search also has among its first n."""
    built, queries = captions(spark, sf_dir), test_captions(spark, sf_dir)
    results = stage(search(queries, built.index, quality.MAX_N, THRESHOLD), "results")
    return quality.recall(results, _exact(spark, sf_dir)).withColumn("recall", F.round("recall", 6))


@query(_recall_sql(DEEP_HITS))
def recall_deep_vs_exact(spark, sf_dir):
    """The same of the deep tree's search."""
    results = stage(deep_search(spark, sf_dir), "results")
    return quality.recall(results, _exact(spark, sf_dir)).withColumn("recall", F.round("recall", 6))


@query(
    sql.with_ctes(
        TEXT_HITS,
        """SELECT query_id, rank, h.doc_id, d.source AS dataset,
           (SELECT count(*) FROM conversations c WHERE c.conv_id = h.doc_id) AS n_captions
           FROM hits h LEFT JOIN documents d ON d.doc_id = h.doc_id""",
    )
)
def search_text_metadata(spark, sf_dir):
    """Results of the text search with data set and number of captions of each item."""
    metadata = caption_counts(*captioned_items(spark, sf_dir)).withColumnRenamed("id", "doc_id")
    results = search(test_captions(spark, sf_dir), captions(spark, sf_dir).index, 20, THRESHOLD)
    return quality.with_metadata(results, metadata).select("query_id", "rank", "doc_id", "dataset", "n_captions")
