"""Token-id files: documents in order of doc_id, coded in blocks of the adaptive range coder.

File format (integers little-endian)::

    file   := "TRC1" vocab:u32 block*
    block  := "BLK1" n_ids:u32 steps:u32 lanes:u32 payload_bytes:u32 table_bytes:u32 crc_ids:u32 crc_table:u32
              table payload
    table  := zlib of n_runs:u32, doc_id:i64 * n_runs, ids:u32 * n_runs, flags:u8 * n_runs, words:u32 * lanes

A run is a stretch of one document's ids in one block; flag 1: the document begins here, 2: it ends here, 4: its doc_id is null.
Blocks are coded independently; both checksums are verified on reading.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bagtree.llm.coder import decode_block, encode_block
from bagtree.llm.files import Whole, open_input
from bagtree.llm.tokens import drops_white_space, encoder
from bagtree.llm.words import slices
from bagtree.sources.scratch import scratch_path, stage

BLOCK_IDS = 1 << 20
FILE_TEXT_BYTES = 32 << 20
_HEAD = struct.Struct("<4s7I")
_BEGINS, _ENDS, _NULL = 1, 2, 4
_WRITTEN = "part int, path string, n_docs long, n_ids long, bytes long"
_READ = "doc_id long, begin long, n_tokens long, ids_crc32 long, part int"


def pack_block(ids: np.ndarray, doc_ids: list[int], counts: list[int], flags: list[int], vocab: int) -> bytes:
    steps, lane_words, payload = encode_block(ids, vocab) if len(ids) else (0, np.empty(0, np.uint32), b"")
    table = zlib.compress(
        struct.pack("<I", len(doc_ids))
        + np.array(doc_ids, "<i8").tobytes()
        + np.array(counts, "<u4").tobytes()
        + np.array(flags, "u1").tobytes()
        + lane_words.astype("<u4").tobytes(),
        1,
    )
    crc = zlib.crc32(ids.astype("<u4").tobytes())
    head = _HEAD.pack(b"BLK1", len(ids), steps, len(lane_words), len(payload), len(table), crc, zlib.crc32(table))
    return head + table + payload


def read_blocks(stream) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, doc ids, counts, flags) of each block; a block that fails its checksum is an error."""
    head = stream.read(8)
    if head[:4] != b"TRC1":
        raise ValueError("not a token-id file")
    vocab = struct.unpack("<I", head[4:])[0]
    while head := stream.read(_HEAD.size):
        magic, n, steps, lanes, payload_bytes, table_bytes, crc, table_crc = _HEAD.unpack(head)
        table, payload = stream.read(table_bytes), stream.read(payload_bytes)
        if magic != b"BLK1" or zlib.crc32(table) != table_crc:
            raise ValueError("damaged block table")
        table = zlib.decompress(table)
        runs = struct.unpack_from("<I", table)[0]
        at = 4
        doc_ids = np.frombuffer(table, "<i8", runs, at)
        counts = np.frombuffer(table, "<u4", runs, at + 8 * runs)
        flags = np.frombuffer(table, "u1", runs, at + 12 * runs)
        words = np.frombuffer(table, "<u4", lanes, at + 13 * runs)
        ids = decode_block(n, steps, words, payload, vocab) if n else np.empty(0, np.uint32)
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("damaged block")
        yield ids, doc_ids, counts, flags


class BlockWriter:
    """Takes documents one after another and writes full blocks; a document may go on in the next block."""

    def __init__(self, path: str, vocab: int, block_ids: int = BLOCK_IDS):
        self.file, self.vocab, self.block_ids = Whole(path), vocab, block_ids
        self.bytes = self.n_ids = self.n_docs = 0
        self._put(b"TRC1" + struct.pack("<I", vocab))
        self._empty()

    def _empty(self) -> None:
        self.parts, self.waiting, self.runs = [], 0, ([], [], [])

    def _put(self, data: bytes) -> None:
        self.file.write(data)
        self.bytes += len(data)

    def _flush(self) -> None:
        if self.runs[0]:
            ids = np.concatenate(self.parts) if self.parts else np.empty(0, np.uint32)
            self._put(pack_block(ids, *self.runs, self.vocab))
        self._empty()

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.n_docs, self.n_ids = self.n_docs + 1, self.n_ids + len(ids)
        flag, null = _BEGINS, _NULL if doc_id is None else 0
        while True:
            part = ids[: self.block_ids - self.waiting]
            ids = ids[len(part) :]
            for column, value in zip(self.runs, (doc_id or 0, len(part), flag | null | (0 if len(ids) else _ENDS))):
                column.append(value)
            self.parts.append(part)
            self.waiting, flag = self.waiting + len(part), 0
            if self.waiting >= self.block_ids:
                self._flush()
            if not len(ids):
                return

    def finish(self) -> None:
        self._flush()
        self.file.finish()


def write_token_files(
    documents: DataFrame, tokenizer: str, end_id: int = 2, vocab: int = 49_408, file_text_bytes: int = FILE_TEXT_BYTES
) -> DataFrame:
    """Write all documents (doc_id, text) in ascending order of doc_id and return the files: part (in that order), path,
    n_docs, n_ids, bytes.

    Each document's ids are its text's (null: none) and ``end_id``. Null doc_ids come first; rows with the same doc_id lie in the order of
    their texts' hashes, so a doc_id of many rows spreads over files. An empty table gives at most empty files.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, -(-total // file_text_bytes))
    folder = scratch_path(spark, "token_files")
    apart = drops_white_space(tokenizer)
    sorted_docs = docs.withColumn("_tie", F.xxhash64("text")).repartitionByRange(files, "doc_id", "_tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:08d}.trc"
        out, encode = BlockWriter(path, vocab), encoder(tokenizer, apart).encode
        end = np.array([end_id], np.uint32)
        try:
            for batch in slices(batches, rows=5000):
                ids, counts = encode(batch["text"])
                ends = np.cumsum(counts)
                for doc_id, n, stop in zip(batch["doc_id"].to_pylist(), counts.tolist(), ends.tolist()):
                    out.add(doc_id, np.concatenate([ids[stop - n : stop], end]))
            out.finish()
        except BaseException:
            out.file.abandon()
            raise
        row = [[part], [path], [out.n_docs], [out.n_ids], [out.bytes]]
        types = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names=_WRITTEN.replace(",", "").split()[::2])

    ordered = sorted_docs.sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    return stage(ordered.mapInArrow(write, _WRITTEN), "token_manifest")


def read_documents(files: DataFrame) -> DataFrame:
    """Read token files back: per document doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids
    as little-endian unsigned 32-bit integers)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, path in zip(batch["part"].to_pylist(), batch["path"].to_pylist()):
                rows, begin, n, crc = [], 0, 0, 0
                with open_input(path) as stream:
                    for ids, doc_ids, counts, flags in read_blocks(stream):
                        data, at = memoryview(ids.astype("<u4").tobytes()), 0
                        for doc_id, count, flag in zip(doc_ids.tolist(), counts.tolist(), flags.tolist()):
                            if flag & _BEGINS:
                                begin, n, crc = begin + n, 0, 0
                            crc = zlib.crc32(data[4 * at : 4 * (at + count)], crc)
                            at, n = at + count, n + count
                            if flag & _ENDS:
                                rows.append((None if flag & _NULL else doc_id, begin, n, crc, part))
                        if len(rows) >= 10_000:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    count = files.count()
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = files.select("part", F.coalesce(before, F.lit(0)).alias("offset"))  # one row per file
    found = files.select("part", "path").repartition(max(1, count), "part").mapInArrow(read, _READ)
    # One row per file goes to the rows of documents, never the other way.
    return found.join(F.broadcast(offsets), "part").select(
        "doc_id", (F.col("offset") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32"
    )


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    return pa.RecordBatch.from_arrays(
        [pa.array(v, t) for v, t in zip(zip(*rows), types)], names=["doc_id", "begin", "n_tokens", "ids_crc32", "part"]
    )
