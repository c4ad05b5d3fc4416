"""Postings in blocks of documents, with the extremes of each term in each block.

A document lies in one block with all its terms. Documents are put in the order of their main term (the deepest, most frequent
node of theirs), their number of terms and a hash of all (term, tf) pairs, then id: documents with the same profile stand side by
side, so the extremes of a block lie close together and its bounds are tight.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagtree.functions.paths import ROOT, depth_of
from bagtree.sources.scratch import stage

DOCS_PER_BLOCK = 32


def doc_profiles(postings: DataFrame) -> DataFrame:
    """(doc_id, main_term, n_terms, profile), from aggregates of fixed size, however many terms a document has."""
    return postings.groupBy("doc_id").agg(
        F.max(F.struct(depth_of(F.col("term_id")).alias("depth"), "tf", "term_id")).getField("term_id").alias("main_term"),
        F.count(F.lit(1)).alias("n_terms"),
        F.bit_xor(F.xxhash64("term_id", "tf")).alias("profile"),
    )


def assign_blocks(postings: DataFrame, batch: str, docs_per_block: int = DOCS_PER_BLOCK) -> DataFrame:
    """(doc_id, block) of the new documents of a batch, whose name makes the blocks' names its own. A written table. Blocks do not run
    over the ends of partitions."""
    if docs_per_block < 1 or docs_per_block & (docs_per_block - 1):
        raise ValueError("docs_per_block must be a power of two")
    order = ["main_term", "n_terms", "profile", "doc_id"]
    placed = doc_profiles(postings).repartitionByRange(*order).sortWithinPartitions(*order)
    # Row numbers within a partition, its number in the bits above them.
    number = F.shiftright(F.monotonically_increasing_id(), docs_per_block.bit_length() - 1)
    return stage(placed.select("doc_id", F.concat(F.lit(f"{batch}:"), number.cast("string")).alias("block")), "doc_blocks")


def with_blocks(postings: DataFrame, doc_blocks: DataFrame) -> DataFrame:
    """Postings (term_id, doc_id, tf) with their document's ``block``."""
    return postings.join(doc_blocks, "doc_id").select("term_id", "doc_id", "tf", "block")


def known_blocks(postings: DataFrame) -> DataFrame:
    """(doc_id, block) of stored documents: every document has the root."""
    return postings.filter(F.col("term_id") == ROOT).select("doc_id", "block")


def block_terms(postings: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(term_id, block, n_docs, max_tf, min_tf, min_doc, max_doc) from postings with blocks.

    ``min_tf`` is 0 where a document of the block lacks the term. ``n_docs``, ``min_doc`` and ``max_doc`` are those of the whole block:
    from the root's postings, or from ``members`` (doc_id, block) if the postings are only some terms of known documents.
    """
    members = known_blocks(postings) if members is None else members
    sizes = members.groupBy("block").agg(
        F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("min_doc"), F.max("doc_id").alias("max_doc")
    )
    terms = postings.groupBy("block", "term_id").agg(
        F.count(F.lit(1)).alias("holders"), F.max("tf").alias("max_tf"), F.min("tf").alias("least_tf")
    )
    every = F.col("holders") == F.col("n_docs")
    return terms.join(sizes, "block").select(
        "term_id", "block", "n_docs", "max_tf", F.when(every, F.col("least_tf")).otherwise(F.lit(0)).cast("long").alias("min_tf"), "min_doc", "max_doc"
    )
