"""Bags of vectors and single features."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Ship this module's code with the tasks, so that executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def explode_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, vectors) -> (doc_id, pos, vec). A document with an empty bag has no features."""
    return docs.select("doc_id", F.posexplode("vectors").alias("pos", "vec"))


def vectors_of(features: DataFrame) -> DataFrame:
    return features.select("vec")


def lookup(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Every id with its row; nulls for an unknown id."""
    return ids.join(table, key, "left")


def extract_features(items: DataFrame, extract: Callable[[bytes], Iterable[Sequence[float]] | None], key: str = "id") -> DataFrame:
    """(doc_id, pos, vec) of items (key, content): the caller's ``extract`` turns one content into its vectors.

    Items travel in Arrow batches; one with no content or no vectors has no features.
    """

    def run(batches):
        for batch in batches:
            rows = [
                (doc, pos, [float(x) for x in vec])
                for doc, content in zip(batch["doc_id"], batch["content"])
                if content is not None
                for pos, vec in enumerate(extract(bytes(content)) or ())
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "pos", "vec"])

    kind = items.schema[key].dataType.simpleString()
    return items.select(F.col(key).alias("doc_id"), "content").mapInPandas(run, f"doc_id {kind}, pos int, vec array<float>")
