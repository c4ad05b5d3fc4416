"""The populate loop as a stream: new files of documents are appended to the active tree as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bagtree.functions.hashing import hash_fraction
from bagtree.operators.tree import TreeShape
from bagtree.plans.index_jobs import FeaturesOf, active_tree_id, populate
from bagtree.sources.scratch import stage, unstage
from bagtree.sources.tables import IndexTables

# Fixed value: seconds between looks at the folder.
POLL_SECONDS = 30

_BUCKETS = 256


def document_stream(tables: IndexTables, path: str, schema, max_files: int = 100, glob: str | None = None) -> DataFrame:
    """New parquet files of a folder, at most ``max_files`` per micro-batch."""
    reader = tables.spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def stream_id(tables: IndexTables, checkpoint: str) -> str:
    """The id that a stream keeps in its checkpoint, written before its first batch."""
    return tables.spark.read.schema("id string").json(f"{checkpoint.rstrip('/')}/metadata").first()["id"]


def in_rounds(docs: DataFrame, max_documents: int) -> DataFrame:
    """``docs`` with ``round``, from 0: each round has ``max_documents`` documents, the last one the rest.

    Documents are dealt in the order of their ids' hashes, so the same documents always make the same rounds. Hash buckets are counted, and
    documents are numbered within their bucket only: no task sorts all of them. All rows of a document are in one round; rows
    without an id are one document.
    """
    if max_documents < 1:
        raise ValueError("a round has at least one document")
    hashed = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    ids = docs.select("doc_id").distinct().withColumn("hash", hashed)
    ids = ids.withColumn("bucket", F.floor(hash_fraction(F.col("hash")) * _BUCKETS).cast("int"))
    sizes = ids.groupBy("bucket").agg(F.count("*").alias("n"))
    before = sizes.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("hash", "doc_id")) - 1
    rounds = ids.join(F.broadcast(before), "bucket").select(
        F.col("doc_id").alias("_id"), F.floor((F.col("before") + place) / max_documents).cast("long").alias("round")
    )
    return docs.join(rounds, docs["doc_id"].eqNullSafe(rounds["_id"])).drop("_id")


def populate_stream(
    tables: IndexTables,
    docs: DataFrame,
    features_of: FeaturesOf,
    checkpoint: str,
    shape: TreeShape = TreeShape(),
    available_now: bool = False,
    max_documents: int | None = None,
) -> StreamingQuery:
    """Append each micro-batch of ``docs`` once.

    The file source cuts micro-batches by files. With ``max_documents`` each is appended in rounds of so many documents, however large its
    files are; a round has a name and a commit of its own, so a micro-batch that fails goes on after its last finished round.

    The sample log keeps out documents the tree has seen, in whatever batch. Batches are named by the stream, which
    its checkpoint identifies, and the batch's number in it: another stream, or this one with a new checkpoint, has names of its
    own. A batch replayed after a failure has the same name: if its commit is there it is skipped, if not its partitions
    are overwritten. Once a new tree takes over, one run of the ``populate`` job brings it the documents of earlier
    micro-batches.
    """
    names: list[str] = []

    def append_batch(batch: DataFrame, batch_id: int) -> None:
        if active_tree_id(tables) is None:
            # Fail rather than go on: the micro-batch then comes again when the stream is restarted.
            raise RuntimeError(f"{tables.namespace} has no finished tree to append to")
        batch = batch.persist()
        try:
            if not names:
                names.append(stream_id(tables, checkpoint))
            name = f"stream-{names[0]}-{batch_id:09d}"
            if max_documents is None:
                populate(tables, batch, features_of, shape, name)
                return
            dealt = stage(in_rounds(batch, max_documents), "rounds")
            last = dealt.agg(F.max("round")).first()[0]
            for number in range(0 if last is None else last + 1):
                of_round = dealt.filter(F.col("round") == number).drop("round")
                populate(tables, of_round, features_of, shape, f"{name}-{number:09d}")
            unstage(dealt)
        finally:
            batch.unpersist()

    writer = docs.writeStream.foreachBatch(append_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{POLL_SECONDS} seconds")
    return writer.start()
