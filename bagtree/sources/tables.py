"""The stored index: parquet tables per namespace, partitioned by tree and batch.

A batch (the training, or one append) writes its own partition of each table in overwrite mode and then its commit: one
small file that carries the batch's sequence number as its name and appears whole or not at all. Readers take committed
batches only, so a batch that dies half-way, at whatever step, is invisible, blocks nobody and can simply run again.

Totals of terms are stored as what each batch adds. A read sums them; ``fold_totals`` writes the sum up to a commit, which
later reads start from.
"""

from __future__ import annotations

import json
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagtree.operators.append import current_assignments
from bagtree.operators.search import Index
from bagtree.operators.tree import NODE_SCHEMA, with_sizes

_TABLES = ("nodes", "assignments", "postings", "blocks", "term_stats", "totals", "sample_log", "commits", "progress", "leases", "trees")
_STATS_SCHEMA = "tree_id string, term_id string, df long, total_tf long"
_BLOCK_SCHEMA = "tree_id string, term_id string, block string, n_docs long, max_tf long, min_tf long, min_doc {doc}, max_doc {doc}"

# Totals are folded once so many batches have come since the last fold.
FOLD_EVERY = 16
_TREE_SCHEMA = "namespace string, tree_id string, created_at timestamp, state string"


class ConcurrentCommit(Exception):
    """Another batch was committed since this one began."""


@dataclass(frozen=True)
class Commit:
    batch_id: str
    seq: int
    docs_count: int


class IndexTables:
    """Tables ``<base>/<namespace>_<table>`` with document ids of type ``doc_type``."""

    def __init__(self, spark: SparkSession, base: str, namespace: str, doc_type: str = "bigint") -> None:
        self.spark, self.base, self.namespace, self.doc_type = spark, base.rstrip("/"), namespace, doc_type
        self._seen: dict[str, Commit] = {}  # commit files never change

    def path(self, table: str) -> str:
        if table not in _TABLES:
            raise ValueError(f"unknown table {table!r}")
        return f"{self.base}/{self.namespace}_{table}"

    # --- versions

    def trees(self) -> DataFrame:
        """One row per tree. A change of state adds a row, and a finished tree's row counts, so no reader ever misses a tree."""
        rows = self._read_all("trees", _TREE_SCHEMA)
        newest = F.max(F.struct((F.col("state") != "training").alias("done"), "created_at", "state"))
        return rows.groupBy("namespace", "tree_id").agg(newest.alias("row")).select(
            "namespace", "tree_id", "row.created_at", "row.state"
        )

    def put_tree(self, tree_id: str, state: str, created_at=None) -> None:
        """Insert a tree or change its state. The time of creation is now unless given."""
        created = F.current_timestamp() if created_at is None else F.lit(created_at)
        row = self.spark.range(1).select(
            F.lit(self.namespace).alias("namespace"), F.lit(tree_id).alias("tree_id"), created.alias("created_at"), F.lit(state).alias("state")
        )
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path('trees')}/{tree_id}/{state}")

    def drop_tree(self, tree_id: str) -> None:
        """Remove a tree with all its partitions, the registry row first so that nobody picks it up."""
        self._delete(f"{self.path('trees')}/{tree_id}")
        for table in _TABLES:
            self._delete(f"{self.path(table)}/tree_id={tree_id}")

    def claim_training(self, tree_id: str) -> str:
        """Take the one training place of the namespace; returns the tree that has it, which is another's if it was taken."""
        path = self._training_claim()
        return tree_id if self._create(path, tree_id) else self._content(path)

    def release_training(self) -> None:
        self._delete(self._training_claim())

    def _training_claim(self) -> str:
        return f"{self.base}/{self.namespace}_training"

    def drop_progress(self, tree_id: str) -> None:
        self._delete(f"{self.path('progress')}/tree_id={tree_id}")

    # --- leases

    def lease(self, tree_id: str, seconds: float) -> str:
        """Note that the tree is read until then, or until ``release``: a reader that dies holds it no longer than it said."""
        path = f"{self.path('leases')}/tree_id={tree_id}/{uuid.uuid4().hex}.json"
        self._create(path, json.dumps({"until": time.time() + seconds}))
        return path

    def release(self, lease: str) -> None:
        self._delete(lease)

    def leased(self, tree_id: str) -> bool:
        """Whether anybody reads the tree."""
        for path in self._files(f"{self.path('leases')}/tree_id={tree_id}/*.json"):
            try:
                if json.loads(self._content(path))["until"] > time.time():
                    return True
            except Py4JJavaError:
                continue  # released since the listing
        return False

    # --- batches

    def commits(self, tree_id: str) -> list[Commit]:
        """Committed batches in order. One small file per batch, each read once."""
        folder = f"{self.path('commits')}/tree_id={tree_id}"
        fs, pattern = self._fs(f"{folder}/seq-*.json")
        found = []
        for status in fs.globStatus(pattern) or []:
            path = status.getPath().toString()
            key = f"{path}@{status.getModificationTime()}"  # a dropped tree's id may come again
            if key not in self._seen:
                row = json.loads(self._content(path))
                self._seen[key] = Commit(row["batch_id"], row["seq"], row["docs_count"])
            found.append(self._seen[key])
        return sorted(found, key=lambda c: c.seq)

    def write_batch(self, tree_id: str, batch_id: str, **tables: DataFrame) -> None:
        """Write the batch's partition of each table, all at a time: they do not depend on each other."""

        def write(table: str, df: DataFrame) -> None:
            own = df.drop("tree_id", "batch_id")
            own.write.mode("overwrite").parquet(f"{self.path(table)}/tree_id={tree_id}/batch_id={batch_id}")

        if not tables:
            return
        with ThreadPoolExecutor(len(tables)) as pool:
            running = [pool.submit(inheritable_thread_target(self.spark)(write), *item) for item in tables.items()]
        for job in running:
            job.result()

    def commit(self, tree_id: str, batch_id: str, seq: int, docs_count: int) -> None:
        """Make a batch visible. Of two batches with one sequence number only the first is committed; a batch may commit again."""
        path = f"{self.path('commits')}/tree_id={tree_id}/seq-{seq:09d}.json"
        if not self._create(path, json.dumps({"batch_id": batch_id, "seq": seq, "docs_count": docs_count})):
            holder = json.loads(self._content(path))["batch_id"]
            if holder != batch_id:
                raise ConcurrentCommit(f"{path} belongs to {holder}; run the batch again")

    # --- totals

    def fold_totals(self, tree_id: str) -> int | None:
        """Write the totals of all commits as one table, from which later reads go on. Returns the commit's number; None if there is
        nothing new. Folds of one commit are equal, so two at once do no harm."""
        commits, folded = self.commits(tree_id), self._folded(tree_id)
        if not commits or (folded is not None and folded >= commits[-1].seq):
            return None
        seq, folder = commits[-1].seq, f"{self.path('totals')}/tree_id={tree_id}"
        path = f"{folder}/{seq:09d}-{uuid.uuid4().hex}"
        self.term_stats(tree_id).drop("tree_id").write.parquet(path)
        self._create(f"{folder}/_fold-{seq:09d}.json", json.dumps({"seq": seq, "path": path}))
        return seq

    def unfolded(self, tree_id: str) -> int:
        """How many batches a read of the totals adds up on top of the last fold."""
        folded = self._folded(tree_id)
        return sum(folded is None or c.seq > folded for c in self.commits(tree_id))

    def _folded(self, tree_id: str) -> int | None:
        folds = self._files(f"{self.path('totals')}/tree_id={tree_id}/_fold-*.json")
        return max((int(path.rsplit("-", 1)[1].split(".")[0]) for path in folds), default=None)

    # --- reading one tree

    def nodes(self, tree_id: str) -> DataFrame:
        """The tree's nodes; their sizes are those after the last batch."""
        nodes = self._read(tree_id, "nodes", NODE_SCHEMA)
        # Nodes without totals keep the sizes of their making.
        return with_sizes(nodes, self.term_stats(tree_id)) if self.commits(tree_id) else nodes

    def assignments(self, tree_id: str) -> DataFrame:
        """Each feature at its current leaf."""
        rows = self._read(tree_id, "assignments", f"tree_id string, term_id string, doc_id {self.doc_type}, pos int, vec array<float>")
        return current_assignments(rows, self.nodes(tree_id))

    def postings(self, tree_id: str) -> DataFrame:
        return self._read(tree_id, "postings", f"tree_id string, term_id string, doc_id {self.doc_type}, tf long, block string")

    def blocks(self, tree_id: str) -> DataFrame:
        """What is known of each block of documents and term; empty where batches were written without blocks."""
        return self._read(tree_id, "blocks", _BLOCK_SCHEMA.format(doc=self.doc_type))

    def term_stats(self, tree_id: str) -> DataFrame:
        """Totals of all terms: the last fold and what later batches added."""
        folded = self._folded(tree_id)
        added = self._read(tree_id, "term_stats", _STATS_SCHEMA, after=folded)
        if folded is not None:
            path = json.loads(self._content(f"{self.path('totals')}/tree_id={tree_id}/_fold-{folded:09d}.json"))["path"]
            own = self.spark.read.schema(_STATS_SCHEMA.split(", ", 1)[1]).parquet(path)
            added = own.withColumn("tree_id", F.lit(tree_id)).unionByName(added)
        return added.groupBy("tree_id", "term_id").agg(F.sum("df").alias("df"), F.sum("total_tf").alias("total_tf"))

    def sample_log(self, tree_id: str) -> DataFrame:
        schema = f"doc_id {self.doc_type}, tree_id string, namespace string, sampled_at timestamp"
        return self._read(tree_id, "sample_log", schema).withColumn("namespace", F.lit(self.namespace))

    def index(self, tree_id: str) -> Index:
        docs_count = self.commits(tree_id)[-1].docs_count
        return Index(
            self.nodes(tree_id).drop("tree_id"),
            self.postings(tree_id).drop("tree_id"),
            self.term_stats(tree_id).drop("tree_id"),
            self.spark.range(1).select(F.lit(docs_count).cast("long").alias("docs_count")),
            self.blocks(tree_id).drop("tree_id"),
        )

    def _read(self, tree_id: str, table: str, schema: str, after: int | None = None) -> DataFrame:
        """The table's partitions of all committed batches, or of those after a commit; a batch need not have the table."""
        commits = [c for c in self.commits(tree_id) if after is None or c.seq > after]
        own = ", ".join(part for part in schema.split(", ") if part.split()[0] not in ("tree_id", "namespace"))
        columns = [part.split()[0] for part in schema.split(", ") if part.split()[0] != "namespace"]
        written = {path.rsplit("=", 1)[1] for path in self._files(f"{self.path(table)}/tree_id={tree_id}/batch_id=*")} if commits else set()
        paths = [f"{self.path(table)}/tree_id={tree_id}/batch_id={c.batch_id}" for c in commits if c.batch_id in written]
        rows = self.spark.read.schema(own).parquet(*paths) if paths else self.spark.createDataFrame([], own)
        return rows.withColumn("tree_id", F.lit(tree_id)).select(*columns)

    def _read_all(self, table: str, schema: str, below: str = "/*") -> DataFrame:
        pattern = f"{self.path(table)}{below}"
        if not self._files(pattern):
            return self.spark.createDataFrame([], schema)
        # The folder names repeat what the rows say and are not read as columns.
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(pattern)

    # --- file system

    def _create(self, path: str, content: str) -> bool:
        """Make a file that appears whole, or not at all if it is there already: written aside, then linked or renamed without
        overwriting. False if it was there. Whoever dies before leaves nothing but a hidden file that nobody reads."""
        fs, final = self._fs(path)
        aside = self._fs(f"{path.rpartition('/')[0]}/_{uuid.uuid4().hex}")[1]
        out = fs.create(aside, True)
        out.write(bytearray(content.encode()))
        out.close()
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        try:
            if fs.getScheme() == "file":
                local = [jvm.java.io.File(fs.makeQualified(p).toUri().getPath()).toPath() for p in (final, aside)]
                jvm.java.nio.file.Files.createLink(*local)
            else:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
                context.rename(aside, final, gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
            return True
        except Py4JJavaError:
            if not fs.exists(final):
                raise
            return False
        finally:
            fs.delete(aside, False)

    def _content(self, path: str) -> str:
        fs, hadoop_path = self._fs(path)
        stream = fs.open(hadoop_path)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _files(self, pattern: str) -> list[str]:
        fs, path = self._fs(pattern)
        return [status.getPath().toString() for status in fs.globStatus(path) or []]

    def _fs(self, path: str):
        hadoop_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop_path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path

    def _delete(self, path: str) -> None:
        fs, hadoop_path = self._fs(path)
        if fs.exists(hadoop_path):
            fs.delete(hadoop_path, True)
