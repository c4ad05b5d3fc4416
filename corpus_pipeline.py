"""From raw documents to shards: toxicity, near duplicates, benchmark leaks, mixture, shards.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last keep the columns of documents. The mixture decides the order of rows: its files hold them in
mixed order, and the shards' slots follow it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bagtree.llm import dartminhash, decontaminate, pfair, shards, toxicity
from bagtree.sources.scratch import stage, unstage

SHARDS = 16


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on this table's labels, scores below 0.5."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return model.accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each class."""
    return dartminhash.representatives(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in files whose order is the mixed order."""
    return pfair.in_mixed_order(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot; slots follow the order of the rows in their files."""
    return shards.shard_in_file_order(docs, shards={n: 1.0 for n in range(SHARDS)})


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixture", mix_sources),
    ("shards", shard),
]

# The classifier, the signatures and the alignment are no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written = None
    for name, function in STAGES[:-1]:
        before, written = written, stage(function(spark, docs, sf_dir), name)
        unstage(before)
        docs = written
    return STAGES[-1][1](spark, docs, sf_dir)
