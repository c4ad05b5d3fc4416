"""What the plans of the costly steps must look like."""

import re

from pyspark.sql import functions as F

from bagtree.operators import cluster
from bagtree.operators.evaluate import exact_topk
from bagtree.operators.postings import docs_count_of, postings_of, term_stats_of
from bagtree.operators.quantize import quantize
from bagtree.operators.search import Index, search
from bagtree.operators.tree import TreeShape, train
from bagtree.sources.scratch import stage
from tests.helpers import random_features


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return re.findall(r"Exchange hashpartitioning\(([^)]*?), \d+\)", re.sub(r"#\d+L?", "", plan(df)))


def test_plans(spark):
    features = stage(random_features(spark), "features")
    tree = train(features, "t", TreeShape(k=4, levels=2, min_samples=20, iters=1, init="hash"))
    postings = stage(postings_of(tree.assignments), "postings")
    index = Index(tree.nodes, postings, stage(term_stats_of(postings), "stats"), docs_count_of(features.select("doc_id").distinct()))

    # Descent by broadcast: no exchange at all, and only the columns it needs.
    placed = quantize(features, tree.nodes).select("doc_id", "term_id")
    assert "Exchange" not in plan(placed) and "CartesianProduct" not in plan(placed)

    # Postings: one exchange, counted before it.
    assert exchanges(postings_of(placed)) == ["term_id, doc_id"] and "partial_count" in plan(postings_of(placed))

    # Search: the kept terms come to the postings, whose scan knows them; nothing is exchanged but scores.
    hits = search(features.withColumnRenamed("doc_id", "query_id"), index, 3, 0.0001)
    assert exchanges(hits) == ["query_id", "query_id, doc_id"]
    assert "BroadcastHashJoin" in plan(hits) and "In(term_id" in plan(hits)
    assert "WindowGroupLimit" in plan(hits)

    # A Lloyd round: partial sums by cluster.
    rows = features.withColumn("term_id", F.lit("0"))
    book = cluster.seeds(rows, [("0", 300)], 4, 8, "hash", "s")
    assert exchanges(cluster.cluster_means(rows, book)) == ["term_id, cluster"]

    # Exact search: no pairs in the plan.
    queries = features.filter("pos = 0").select(F.col("doc_id").alias("query_id"), "vec")
    best = exact_topk(features.select("doc_id", "vec"), queries, 3)
    assert not re.search("CartesianProduct|NestedLoopJoin", plan(best))
