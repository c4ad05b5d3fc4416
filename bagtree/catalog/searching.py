"""Term weights, top-n search, feedback and two-step search."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from bagtree.catalog import sql
from bagtree.catalog.data import DEEP, THRESHOLD, build_index, captions, deep_captions, picture_features, pictures, test_captions
from bagtree.catalog.registry import query
from bagtree.operators.blocks import assign_blocks, block_terms, with_blocks
from bagtree.operators.feedback import NEAREST_CAPTIONS, feedback_bag
from bagtree.operators.search import TF_IDF_THRESHOLD, prune, query_terms, search, term_weights
from bagtree.operators.tree import TreeShape
from bagtree.sources.scratch import stage

_PICTURE_INDEX = [sql.PICTURES, *sql.tree("pics"), *sql.postings("tree_leaves")]
_SELF_QUERIES = [
    *_PICTURE_INDEX,
    "asked AS (SELECT doc_id AS query_id, pos, v FROM pics)",
    *sql.descend("asked", "query_id", "tree_nodes", "asked_leaves"),
    *sql.weights("asked_leaves", "pics"),
]
_CAPTION_INDEX = [*sql.CAPTIONS, *sql.tree("caps"), *sql.postings("tree_leaves")]
_TEXT_QUERIES = [
    *_CAPTION_INDEX,
    *sql.TEST_CAPTIONS,
    *sql.descend("tests", "query_id", "tree_nodes", "test_leaves"),
    *sql.weights("test_leaves", "caps"),
]
TEXT_HITS = [*_TEXT_QUERIES, *sql.ranking(20, THRESHOLD)]
TEXT_TOP5 = [*_TEXT_QUERIES, *sql.ranking(NEAREST_CAPTIONS, THRESHOLD)]


def _self_queries(built):
    return built.features.withColumnRenamed("doc_id", "query_id")


@query(sql.with_ctes(_SELF_QUERIES, "SELECT query_id, term_id, query_tf FROM w_tf"))
def query_tf(spark, sf_dir):
    """How often each query visits each node; every picture is a query."""
    built = pictures(spark, sf_dir)
    return query_terms(_self_queries(built), built.index.nodes).select("query_id", "term_id", "query_tf")


def _rounded(weights):
    return weights.withColumn("idf", F.round("idf", 6)).withColumn("q_weight", F.round("q_weight", 6))


_WEIGHT_COLUMNS = "query_id, term_id, query_tf, df, total_tf, round(idf, 6) AS idf, round(q_weight, 6) AS q_weight"


@query(sql.with_ctes(_SELF_QUERIES, f"SELECT {_WEIGHT_COLUMNS} FROM w"))
def query_term_weights(spark, sf_dir):
    """tf-idf weight of each query term."""
    built = pictures(spark, sf_dir)
    return _rounded(term_weights(query_terms(_self_queries(built), built.index.nodes), built.index))


@query(sql.with_ctes(_SELF_QUERIES, f"SELECT {_WEIGHT_COLUMNS} FROM w WHERE q_weight >= {THRESHOLD}"))
def pruned_terms(spark, sf_dir):
    """The query terms that take part."""
    built = pictures(spark, sf_dir)
    weights = term_weights(query_terms(_self_queries(built), built.index.nodes), built.index)
    return _rounded(prune(weights, THRESHOLD))


_HITS = "SELECT query_id, rank, doc_id, round(distance, 6) AS distance FROM hits"


def _output(hits):
    return hits.withColumn("distance", F.round("distance", 6))


@query(sql.with_ctes([*_SELF_QUERIES, *sql.ranking(5, THRESHOLD, exclude_self=True)], _HITS))
def search_topn(spark, sf_dir):
    """For every picture the five most like it, itself left out."""
    built = pictures(spark, sf_dir)
    return _output(search(_self_queries(built), built.index, 5, THRESHOLD, exclude_self=True))


def _in_blocks(built, name):
    """The index with its postings in blocks, made once per session."""
    key = (id(built), name)
    if key not in _blocked:
        placed = assign_blocks(built.index.postings, name)
        postings = stage(with_blocks(built.index.postings, placed).sortWithinPartitions("term_id", "block"), "postings")
        _blocked[key] = replace(built.index, postings=postings, blocks=stage(block_terms(postings), "blocks"))
    return _blocked[key]


_blocked: dict[tuple, object] = {}


@query(sql.with_ctes([*_SELF_QUERIES, *sql.ranking(5, THRESHOLD, exclude_self=True)], _HITS))
def search_topn_in_blocks(spark, sf_dir):
    """The same as ``search_topn``, from blocks of postings: those that cannot hold an answer are not read."""
    built = pictures(spark, sf_dir)
    return _output(search(_self_queries(built), _in_blocks(built, "ims"), 5, THRESHOLD, exclude_self=True))


_FLAT = [
    sql.PICTURES,
    *sql.tree("pics", k=10, levels=1),
    *sql.postings("tree_leaves"),
    "asked AS (SELECT doc_id AS query_id, pos, v FROM pics)",
    *sql.descend("asked", "query_id", "tree_nodes", "asked_leaves", levels=1),
    *sql.weights("asked_leaves", "pics"),
    *sql.ranking(5, 0.005),
]


@query(sql.with_ctes(_FLAT, _HITS))
def search_embeddings(spark, sf_dir):
    """From raw vectors to ranked pictures in one go: a flat tree of ten words, its index, every picture asked."""
    shape = TreeShape(k=10, levels=1, min_samples=20, iters=1, init="hash")
    built = build_index(picture_features(spark, sf_dir), "flat", shape)
    return _output(search(_self_queries(built), built.index, 5, 0.005))


@query(sql.with_ctes(TEXT_HITS, _HITS))
def search_text_in_blocks(spark, sf_dir):
    """The same as ``search_text``, from blocks of postings."""
    return _output(search(test_captions(spark, sf_dir), _in_blocks(captions(spark, sf_dir), "captions"), 20, THRESHOLD))


DEEP_HITS = [
    *sql.CAPTIONS,
    *sql.tree("caps", k=DEEP.k, levels=DEEP.levels, min_samples=DEEP.min_samples),
    *sql.postings("tree_leaves"),
    *sql.TEST_CAPTIONS,
    *sql.descend("tests", "query_id", "tree_nodes", "test_leaves", levels=DEEP.levels),
    *sql.weights("test_leaves", "caps"),
    *sql.ranking(20, TF_IDF_THRESHOLD),
]


def deep_search(spark, sf_dir):
    index = _in_blocks(deep_captions(spark, sf_dir), "deep")
    return search(test_captions(spark, sf_dir), index, 20, TF_IDF_THRESHOLD)


@query(sql.with_ctes(DEEP_HITS, "SELECT query_id, rank, doc_id, distance FROM hits"))
def search_text_deep(spark, sf_dir):
    """The text search in a tree with leaves of a few captions, at the default threshold, through blocks. Distances keep the digits they
    are compared at: rounded again, a 5 at the cut goes up in one engine and down in the other."""
    return deep_search(spark, sf_dir)


@query(sql.with_ctes(TEXT_HITS, _HITS))
def search_text(spark, sf_dir):
    """For every test caption the twenty captioned items nearest to it."""
    return _output(search(test_captions(spark, sf_dir), captions(spark, sf_dir).index, 20, THRESHOLD))


_BAG = [
    *TEXT_TOP5,
    sql.PICTURES,
    "given AS (SELECT query_id, rank, doc_id, pos, v, count(*) OVER (PARTITION BY query_id, doc_id) AS n FROM hits JOIN pics USING (doc_id))",
    """sizes AS (SELECT query_id, CAST(floor(sum((SELECT count(*) FROM pics p WHERE p.doc_id = hits.doc_id)) / count(*)) AS BIGINT)
       AS bag_size FROM hits GROUP BY query_id)""",
    """drawn AS (SELECT * FROM given QUALIFY row_number() OVER (PARTITION BY query_id, doc_id
       ORDER BY md5('feedback:' || query_id || ':' || doc_id || ':' || pos), pos) <= floor(n / log2(rank + 1)))""",
    """bag AS (SELECT query_id, doc_id, pos, v FROM drawn JOIN sizes USING (query_id) QUALIFY row_number() OVER (PARTITION BY query_id
       ORDER BY md5('feedback:pool:' || query_id || ':' || doc_id || ':' || pos), doc_id, pos) <= bag_size)""",
]


def _bag(spark, sf_dir):
    nearest = search(test_captions(spark, sf_dir), captions(spark, sf_dir).index, NEAREST_CAPTIONS, THRESHOLD)
    return feedback_bag(nearest, pictures(spark, sf_dir).features)


@query(sql.with_ctes(_BAG, "SELECT query_id, doc_id, pos, round(list_sum(v), 6) AS vec_sum FROM bag"))
def feedback_bags(spark, sf_dir):
    """Test captions turned into bags of descriptors of the pictures they found."""
    total = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return _bag(spark, sf_dir).select("query_id", "doc_id", "pos", F.round(total, 6).alias("vec_sum"))


TWO_STEP = [
    *_BAG,
    *sql.tree("pics", "ims"),
    *sql.postings("ims_leaves", "ims_post"),
    "bag_queries AS (SELECT query_id, CAST(doc_id * 5 + pos AS BIGINT) AS pos, v FROM bag)",
    *sql.descend("bag_queries", "query_id", "ims_nodes", "bag_leaves"),
    *sql.weights("bag_leaves", "pics", "bw", "ims_post_stats"),
    *sql.ranking(20, THRESHOLD, "found", "bw", "ims_post"),
]


def feedback_queries(spark, sf_dir):
    """The bags as a written table, to be asked of the pictures."""
    return stage(_bag(spark, sf_dir), "bag")


@query(sql.with_ctes(TWO_STEP, "SELECT query_id, rank, doc_id, round(distance, 6) AS distance FROM found"))
def search_two_step(spark, sf_dir):
    """For every test caption the twenty pictures, captioned or not, that look like those its words found."""
    return _output(search(feedback_queries(spark, sf_dir), pictures(spark, sf_dir).index, 20, THRESHOLD))
