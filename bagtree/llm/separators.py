"""Token counts of flat token files without an index, by a scan for the end-of-document id.

Files are cut into blocks of equal size that tasks read by themselves. A block gives the places of its separators, found
with one vectorised comparison. A prefix scan over the blocks of a file (one row each: how many separators, where the last
one is) then tells each block how many documents end before it and where the document that runs into it began.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bagtree.llm.files import Whole, open_input
from bagtree.llm.tokens import drops_white_space, encoder
from bagtree.llm.words import slices
from bagtree.sources.scratch import scratch_path, stage

BLOCK_BYTES = 4 << 20
END_ID = 49_407
_WRITTEN = "part int, path string, ordinal long, doc_id long, bytes long"
_SCANNED = "part int, block long, ids long, positions array<long>"


def write_flat(documents: DataFrame, tokenizer: str, end_id: int = END_ID, dtype: str = "<u2") -> DataFrame:
    """Write the ids of each partition's documents (doc_id, text; a null text has none) as one flat file, ``end_id`` after
    each. The strings of special tokens count as ordinary text, so ``end_id`` stands nowhere else.

    Returns part, path, bytes (of the file), and which document is the file's nth: ordinal, doc_id. A partition without
    documents writes no file.
    """
    folder = scratch_path(documents.sparkSession, "flat_files")
    apart = drops_white_space(tokenizer)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:08d}.bin"
        encode, out, doc_ids, size = encoder(tokenizer, apart, True).encode, None, [], 0
        try:
            for batch in slices(batches, rows=5000):
                ids, counts = encode(batch["text"])
                flat = np.insert(ids, np.cumsum(counts), end_id).astype(dtype)
                out = out or Whole(path)
                out.write(flat.tobytes())
                size += flat.nbytes
                doc_ids.append(batch["doc_id"].cast(pa.int64()))
            if out:
                out.finish()
        except BaseException:
            if out:
                out.abandon()
            raise
        ordinal = 0
        for ids in doc_ids:
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, part, np.int32)),
                    pa.array([path] * n),
                    pa.array(np.arange(ordinal, ordinal + n)),
                    ids,
                    pa.array(np.full(n, size, np.int64)),
                ],
                names=["part", "path", "ordinal", "doc_id", "bytes"],
            )
            ordinal += n

    return stage(documents.select("doc_id", "text").mapInArrow(write, _WRITTEN), "flat_manifest")


def count_documents(files: DataFrame, end_id: int = END_ID, dtype: str = "<u2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents of flat files (part, path, bytes): part, ordinal, start (in the file), n_tokens (without ``end_id``),
    complete (false where the file ends without ``end_id``).

    Two separators in a row hold an empty document. An empty file has no documents. ``block_bytes`` and the files' sizes are
    whole numbers of ids.
    """
    width = np.dtype(dtype).itemsize
    step = max(width, block_bytes // width * width)
    blocks = files.where(F.col("bytes") > 0).select(
        "part",
        "path",
        "bytes",
        F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(bytes - 1) div {step}"))).alias("block"),
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = row["block"] * step
                with open_input(row["path"]) as stream:
                    stream.seek(at)
                    ids = np.frombuffer(stream.read(min(step, row["bytes"] - at)), dtype)
                found = np.flatnonzero(ids == end_id) + at // width
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]], pa.int32()),
                        pa.array([row["block"]], pa.int64()),
                        pa.array([len(ids)], pa.int64()),
                        pa.array([found], pa.list_(pa.int64())),
                    ],
                    names=["part", "block", "ids", "positions"],
                )

    tasks = max(1, blocks.count())
    spread = blocks.repartition(min(tasks, 4096), "part", "block")
    scanned = stage(spread.mapInArrow(scan, _SCANNED), "separators")

    order = Window.partitionBy("part").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    n = F.size("positions")
    last = F.when(n > 0, F.element_at("positions", -1))
    carried = scanned.select("part", "block", n.alias("n"), last.alias("last"), "ids").select(
        "part",
        "block",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ended"),
        F.coalesce(F.max("last").over(before), F.lit(-1)).alias("carry"),
    )
    ends = scanned.join(carried, ["part", "block"]).select(
        "part", "ended", "carry", "positions", F.posexplode("positions").alias("nth", "end")
    )
    start = F.when(F.col("nth") == 0, F.col("carry")).otherwise(F.get("positions", F.col("nth") - 1)) + 1
    closed = ends.select(
        "part",
        (F.col("ended") + F.col("nth")).alias("ordinal"),
        start.alias("start"),
        (F.col("end") - start).alias("n_tokens"),
        F.lit(True).alias("complete"),
    )
    totals = scanned.groupBy("part").agg(F.sum("ids").alias("ids"), F.sum(n).alias("ordinal"), F.max(last).alias("last"))
    tail_start = F.coalesce(F.col("last"), F.lit(-1)) + 1
    open_end = totals.where(F.col("ids") > tail_start).select(
        "part",
        F.col("ordinal").cast("long"),
        tail_start.alias("start"),
        (F.col("ids") - tail_start).alias("n_tokens"),
        F.lit(False).alias("complete"),
    )
    return closed.unionByName(open_end)


def document_token_counts(documents: DataFrame, tokenizer: str) -> DataFrame:
    """Each document's token count, read from flat files: doc_id, n_tokens (without the separator), file, ordinal, start."""
    written = write_flat(documents, tokenizer)
    files = written.groupBy("part").agg(F.first("path").alias("path"), F.first("bytes").alias("bytes"))
    counts = count_documents(files)
    return counts.join(written.select("part", "ordinal", "doc_id"), ["part", "ordinal"]).select(
        "doc_id", "n_tokens", F.col("part").alias("file"), "ordinal", "start"
    )
