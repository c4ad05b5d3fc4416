"""Captioned items: the caption file, item metadata and picture files.

Captions are stored as rows (id, source, pos, text) beside the metadata (id, dataset): ``source`` is the file that a caption comes
from and ``pos`` its place there, so captions of one item may come from any number of files and seeds. A list per item would put all
captions of an item, however many, into one value; lists are made only in answers about single items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bagtree.sources.scratch import path_exists, stage, unstage

# The fields of a caption file's images and annotations, and the extension of picture files.
RECORD_SCHEMA = "id bigint, file_name string, image_id bigint, caption string"
IMAGE_EXTENSION = "jpg"

CONTENT_SCHEMA = "id string, content binary"
METADATA_SCHEMA = "id string, dataset string"
CAPTION_SCHEMA = "id string, source string, pos int, text string"


class OrphanAnnotations(Exception):
    """Captions that name an image the file does not list."""


# The innermost object that is open at the end of a text: its fields are strings and whatever has neither braces nor quotes.
_OPEN_OBJECT = r'(?s)\{(?:[^{}"]++|"(?:[^"\\]++|\\.)*+")*+$'
_ALL_BUT_QUOTES = r'(?s)\\.|[^"\\]+'


def read_caption_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(images, annotations) of caption files, each one JSON object with two arrays of flat records.

    A file is read by byte ranges: the text source ends a row at every closing brace, wherever a task begins. Whether a row ends
    inside a string, so that its brace belongs to a caption, follows from the quotes before it: they are summed within a range, and one row
    per range carries the sums on. Such rows are joined with their successors; all others are records of their own.
    """
    rows = spark.read.option("lineSep", "}").text(path).select(
        "value",
        F.col("_metadata.file_name").alias("source"),
        F.col("_metadata.file_block_start").alias("range"),
        F.monotonically_increasing_id().alias("number"),
        F.pmod(F.length(F.regexp_replace("value", _ALL_BUT_QUOTES, "")), F.lit(2)).alias("odd"),
    )
    rows = stage(rows, "caption_text")
    in_range = Window.partitionBy("source", "range").orderBy("number")
    sums = rows.groupBy("source", "range").agg(F.sum("odd").alias("odd"), F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(
        "source",
        "range",
        F.coalesce(F.sum("odd").over(earlier), F.lit(0)).alias("odd_before"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"),
    )
    placed = rows.select(
        "*", F.sum("odd").over(in_range).alias("odd_here"), (F.row_number().over(in_range) - 1).alias("place")
    ).join(before, ["source", "range"])
    quotes = F.col("odd_before") + F.col("odd_here")
    placed = placed.select(
        "source",
        "value",
        (F.col("n_before") + F.col("place")).cast("int").alias("seq"),
        (F.pmod(quotes - F.col("odd"), F.lit(2)) == 1).alias("begins_inside"),
        (F.pmod(quotes, F.lit(2)) == 1).alias("ends_inside"),
    )
    whole = placed.filter(~F.col("begins_inside") & ~F.col("ends_inside")).select("source", "seq", "value")
    # Only texts with a closing brace in a caption.
    cut = placed.filter(F.col("begins_inside") | F.col("ends_inside"))
    chain = F.sum(F.when(F.col("begins_inside"), 0).otherwise(1)).over(Window.partitionBy("source").orderBy("seq"))
    pieces = F.array_sort(F.collect_list(F.struct("seq", "value")))
    mended = cut.withColumn("chain", chain).groupBy("source", "chain").agg(
        F.min("seq").alias("seq"), F.array_join(pieces.getField("value"), "}").alias("value")
    )
    text = F.concat(F.regexp_extract("value", _OPEN_OBJECT, 0), F.lit("}"))
    records = whole.unionByName(mended.select("source", "seq", "value")).select("source", "seq", F.from_json(text, RECORD_SCHEMA).alias("r"))
    records = records.select("source", "seq", "r.*")
    records = stage(records.filter("file_name IS NOT NULL OR image_id IS NOT NULL OR caption IS NOT NULL"), "caption_records")
    unstage(rows)
    annotated = F.col("image_id").isNotNull() | F.col("caption").isNotNull()
    images = records.filter(~annotated).select("id", "file_name").distinct()
    return images, records.filter(annotated).select("image_id", "caption", "seq", "source")


def caption_rows(annotations: DataFrame) -> DataFrame:
    """(id, source, pos, text); ``pos`` orders the captions of an item that come from one file."""
    source = F.col("source") if "source" in annotations.columns else F.lit("")
    return annotations.select(
        F.col("image_id").alias("id"), source.alias("source"), F.col("seq").alias("pos"), F.col("caption").alias("text")
    )


def numbered_captions(captions: DataFrame) -> DataFrame:
    """Captions with ``pos`` counted from 0 per item, over all its sources."""
    order = Window.partitionBy("id").orderBy("source", "pos", F.md5("text"))
    return captions.withColumn("pos", F.row_number().over(order) - 1).drop("source")


def caption_counts(items: DataFrame, captions: DataFrame) -> DataFrame:
    """Items with ``n_captions``; items without captions stay, with 0. Captions are counted before the exchange."""
    counts = captions.groupBy("id").agg(F.count("*").alias("n_captions"))
    return items.join(counts, "id", "left").withColumn("n_captions", F.coalesce("n_captions", F.lit(0).cast("bigint")))


def fold_captions(items: DataFrame, captions: DataFrame) -> DataFrame:
    """Items with their ``captions`` as a list, empty without any: for an answer about a few items."""
    lists = captions.join(items.select("id"), "id", "left_semi").groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct(*_place(captions), "pos", "text"))).alias("captions")
    )
    return items.join(lists, "id", "left").withColumn(
        "captions", F.coalesce(F.col("captions.text"), F.array().cast("array<string>"))
    )


def _place(captions: DataFrame) -> list[str]:
    return ["source"] if "source" in captions.columns else []


def orphan_annotations(images: DataFrame, annotations: DataFrame) -> DataFrame:
    return annotations.join(images.select(F.col("id").alias("image_id")), "image_id", "left_anti")


def read_captioned_images(spark: SparkSession, path: str, dataset: str) -> tuple[DataFrame, DataFrame]:
    """(items, captions) of a caption file, or a folder of them: (id, file_name, dataset) and (id, source, pos, text).

    An item without captions is an item all the same, one that several files list is one item, with the captions of all; a caption of
    an unknown image is an error.
    """
    images, annotations = read_caption_file(spark, path)
    orphan = orphan_annotations(images, annotations).first()
    if orphan is not None:
        raise OrphanAnnotations(f"caption of unknown image {orphan['image_id']}")
    return images.withColumn("dataset", F.lit(dataset)), caption_rows(annotations)


def image_path(base: str, image_id: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), image_id.cast("string"), F.lit(f".{IMAGE_EXTENSION}"))


def read_image_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, id, content): file name and, without its extension, the id; content as bytes."""
    files = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("file_name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("id"), "content")


def with_content(items: DataFrame, files: DataFrame, key: str = "file_name") -> DataFrame:
    """Items with their picture's bytes; null where the file is missing."""
    return items.join(files.select(key, "content"), key, "left")


def store_images(items: DataFrame, captions: DataFrame, base: str) -> None:
    """Store items (id, dataset, content) and their captions: metadata last, so that it never names what is missing.

    An item is stored once: what the tables have already is left out, so a job may run again, whole or after a failure.
    Within one call the least row of an id counts. A caption is known by item, source, place and text: another text, or the same from
    another file, is a further caption, also of an item that is stored already. ``captions`` is (id, pos, text), with or without source.
    """
    spark = items.sparkSession
    new = items.groupBy("id").agg(F.min(F.struct("dataset", "content")).alias("item")).select("id", "item.*")
    source = F.coalesce("source", F.lit("")) if "source" in captions.columns else F.lit("")
    lines = captions.select("id", source.alias("source"), F.col("pos").cast("int").alias("pos"), "text").distinct()
    for rows, table, schema, keys in (
        (new.select("id", "content"), "content", CONTENT_SCHEMA, ["id"]),
        (lines, "captions", CAPTION_SCHEMA, ["id", "source", "pos", "text"]),
        (new.select("id", "dataset"), "image_metadata", METADATA_SCHEMA, ["id"]),
    ):
        path = f"{base}/{table}"
        fresh = rows
        if path_exists(spark, path):
            stored = spark.read.schema(schema).parquet(path).select(*[F.col(k).alias(f"_{k}") for k in keys])
            fresh = rows.join(stored, [rows[k].eqNullSafe(stored[f"_{k}"]) for k in keys], "left_anti")
        writer = fresh.write.mode("append")
        (writer.partitionBy("dataset") if table == "image_metadata" else writer).parquet(path)


def read_metadata(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema(METADATA_SCHEMA).parquet(f"{base}/image_metadata")


def read_captions(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema(CAPTION_SCHEMA).parquet(f"{base}/captions")
