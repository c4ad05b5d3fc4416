"""Search for captioned pictures: two indexes (captions, pictures) over one metadata table."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagtree.operators import evaluate as quality
from bagtree.operators.encode import Encoder, encode_text, hashed_words
from bagtree.operators.feedback import NEAREST_CAPTIONS, feedback_bag
from bagtree.operators.search import TF_IDF_THRESHOLD, search
from bagtree.operators.tree import TreeShape
from bagtree.operators.versions import TrainingInProgress
from bagtree.plans import index_jobs
from bagtree.sources import captions as source
from bagtree.sources.scratch import stage
from bagtree.sources.tables import IndexTables


# The namespaces of the two indexes.
CAPTIONS = "captions"
PICTURES = "ims"


class NodeNotFound(Exception):
    """There is no finished tree to search."""


@dataclass
class SearchService:
    """``picture_features`` (doc_id, pos, vec) are the pictures' descriptors, from whichever extractor."""

    spark: SparkSession
    base: str
    picture_features: DataFrame
    encoder: Encoder = field(default_factory=hashed_words)
    shape: TreeShape = TreeShape()
    threshold: float = TF_IDF_THRESHOLD
    # Needed only where a training sample may turn out empty.
    caption_dim: int | None = None
    picture_dim: int | None = None

    def __post_init__(self) -> None:
        self.caption_index = IndexTables(self.spark, self.base, CAPTIONS, "string")
        self.picture_index = IndexTables(self.spark, self.base, PICTURES, "string")
        self._held: dict[str, str | None] = {}

    # --- ingest

    def seed(self, caption_file: str, image_folder: str, dataset: str) -> None:
        """Store the pictures and captions of a data set; ids are the md5 of data set and file name."""
        items, captions = source.read_captioned_images(self.spark, caption_file, dataset)
        items = source.with_content(items, source.read_image_files(self.spark, image_folder))
        stored_id = F.md5(F.concat_ws(":", "dataset", "file_name")).alias("stored_id")
        ids = items.select("id", stored_id)
        self.seed_items(
            items.select(stored_id.alias("id"), "dataset", "content"),
            captions.join(ids, "id").select(F.col("stored_id").alias("id"), "source", "pos", "text"),
        )

    def seed_items(self, items: DataFrame, captions: DataFrame) -> None:
        source.store_images(items, captions, self.base)

    def metadata(self) -> DataFrame:
        return source.read_metadata(self.spark, self.base)

    def captions(self) -> DataFrame:
        return source.read_captions(self.spark, self.base)

    def metadata_of(self, ids: DataFrame) -> DataFrame:
        """(id, dataset, captions) of the given ids; no data set and no captions for an unknown id."""
        return source.fold_captions(ids.join(self.metadata(), "id", "left"), self.captions())

    def image_paths(self, ids: DataFrame) -> DataFrame:
        return ids.withColumn("path", source.image_path(f"{self.base}/content", F.col("id")))

    # --- build and grow

    def _docs(self) -> DataFrame:
        return self.metadata().withColumn("doc_id", F.col("id"))

    def _caption_features(self, docs: DataFrame) -> DataFrame:
        chosen = self.captions().join(docs.select(F.col("doc_id").alias("id")), "id", "left_semi")
        return encode_text(source.numbered_captions(chosen).withColumnRenamed("id", "doc_id"), self.encoder)

    def _picture_features(self, docs: DataFrame) -> DataFrame:
        return self.picture_features.join(docs.select("doc_id"), "doc_id", "left_semi")

    def _trees(self):
        return (
            (self.caption_index, self._caption_features, self.caption_dim),
            (self.picture_index, self._picture_features, self.picture_dim),
        )

    def train(self, captions_sample_size: int, ims_sample_size: int) -> None:
        """Train new trees. A namespace whose training is under way is left alone."""
        for (tables, features_of, dim), size in zip(self._trees(), (captions_sample_size, ims_sample_size)):
            try:
                index_jobs.start_training(tables, self._docs(), features_of, size, self.shape, dim=dim)
            except TrainingInProgress:
                continue

    def populate(self) -> bool:
        """Add the documents the trees have not seen; false if there was none."""
        return any([index_jobs.populate(tables, self._docs(), of, self.shape) for tables, of, _ in self._trees()])

    def retire(self) -> list[str]:
        return [tree for tables, _, _ in self._trees() for tree in index_jobs.retire(tables)]

    # --- search

    @contextmanager
    def reading(self, seconds: float = index_jobs.LEASE_SECONDS) -> Iterator[SearchService]:
        """Within the block all searches read the trees that are active at its beginning, and these are not retired. Answers are
        DataFrames: collect or write them before the block ends."""
        with ExitStack() as leases:
            held = {t.namespace: leases.enter_context(index_jobs.reading(t, seconds)) for t, _, _ in self._trees()}
            before, self._held = self._held, held
            try:
                yield self
            finally:
                self._held = before

    def _search(self, tables: IndexTables, queries: DataFrame, n: int) -> DataFrame:
        tree_id = self._held[tables.namespace] if tables.namespace in self._held else index_jobs.active_tree_id(tables)
        if tree_id is None:
            raise NodeNotFound(f"no finished tree in {tables.namespace}")
        return search(queries, tables.index(tree_id), n, self.threshold)

    def encode_queries(self, texts: DataFrame) -> DataFrame:
        """(query_id, text) -> (query_id, pos, vec)."""
        return encode_text(texts, self.encoder).select("query_id", F.lit(0).alias("pos"), "vec")

    def query_labeled(self, texts: DataFrame, n: int) -> DataFrame:
        """Pictures whose captions are nearest to each text: (query_id, rank, doc_id, distance)."""
        return self._search(self.caption_index, self.encode_queries(texts), n)

    def query_all(self, texts: DataFrame, n: int) -> DataFrame:
        """Pictures, with captions or without, that look like those of the nearest captions."""
        nearest = self.query_labeled(texts, NEAREST_CAPTIONS)
        bag = stage(feedback_bag(nearest, self.picture_features), "bag")
        return self._search(self.picture_index, bag, n)

    # --- quality

    def experiment(self, texts: DataFrame, ideal: DataFrame | None = None, ns: tuple[int, ...] = quality.NS) -> DataFrame:
        """(variant, n, mean_precision, mean_ndcg, mean_duration_sec) of both searches, on the same trees throughout.

        Each n is searched on its own, as its time counts; all queries run as one job.
        """
        with self.reading():
            return self._experiment(texts, ideal, ns)

    def _experiment(self, texts: DataFrame, ideal: DataFrame | None, ns: tuple[int, ...]) -> DataFrame:
        queries = stage(self.encode_queries(texts), "queries")
        captions = stage(self._caption_features(self._docs()), "captions")
        ideal = stage(ideal if ideal is not None else quality.ideal_relevances(captions, queries), "ideal")
        total = queries.count()
        measured, times = None, []
        for variant, run in (("labeled_only", self.query_labeled), ("all", self.query_all)):
            for n in ns:
                start = time.perf_counter()
                results = stage(run(texts, n), "results")
                times.append((variant, n, (time.perf_counter() - start) / total))
                scored = quality.similarities(results, captions, queries)
                relevant = quality.relevances(scored, ideal).withColumn("variant", F.lit(variant)).withColumn("n", F.lit(n))
                measured = relevant if measured is None else measured.unionByName(relevant)
        durations = self.spark.createDataFrame(times, "variant string, n int, mean_duration_sec double")
        return quality.mean_quality(measured, queries).join(durations, ["variant", "n"])
