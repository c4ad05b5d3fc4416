"""Captions, metadata, encoding and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from bagtree.catalog import sql
from bagtree.catalog.data import DIM, picture_features, table
from bagtree.catalog.registry import query
from bagtree.operators.encode import char_ngrams, encode_text, hashed_term_weights, hashed_words
from bagtree.operators.features import explode_documents, extract_features, lookup, vectors_of
from bagtree.operators.sample import log_entries, sample_next, unsampled, unsampled_count, unsampled_of_batch
from bagtree.functions.weights import sample_ratio
from bagtree.sources.captions import (
    caption_counts,
    caption_rows,
    image_path,
    numbered_captions,
    orphan_annotations,
    read_captioned_images,
    read_captions,
    read_metadata,
    store_images,
)
from bagtree.sources.scratch import scratch_path


def captioned_items(spark, sf_dir):
    """(items, captions): documents are the images, turns of conversations their annotations."""
    images = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("dataset"))
    notes = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("image_id"), F.col("text").alias("caption"), F.col("turn").alias("seq")
    )
    return images, caption_rows(notes)


@query(
    """SELECT d.doc_id AS id, d.source AS dataset, count(c.text) AS n_captions
       FROM documents d LEFT JOIN conversations c ON c.conv_id = d.doc_id GROUP BY d.doc_id, d.source"""
)
def ingest_images(spark, sf_dir):
    """Images with the number of their captions; an image without captions stays."""
    return caption_counts(*captioned_items(spark, sf_dir))


@query(
    """SELECT d.doc_id AS id, d.source AS dataset, turn AS pos, md5(c.text) AS text_hash
       FROM documents d LEFT JOIN conversations c ON c.conv_id = d.doc_id"""
)
def ingest_captions(spark, sf_dir):
    """Images joined with their captions, a row each; an image without captions has one row of nulls."""
    images, captions = captioned_items(spark, sf_dir)
    return images.join(captions, "id", "left").select("id", "dataset", "pos", F.md5("text").alias("text_hash"))


@query(
    """WITH c AS (SELECT DISTINCT conv_id, turn % 2 AS file, turn, text FROM conversations)
       SELECT doc_id AS id, count(c.text) AS n_captions, count(DISTINCT c.text) AS n_texts, count(DISTINCT file) AS n_files,
              max(CASE WHEN c.text IS NULL THEN 0 ELSE 1 END) AS captioned, md5(coalesce(min(c.text), '')) AS first_text
       FROM documents LEFT JOIN c ON conv_id = doc_id GROUP BY doc_id"""
)
def ingest_two_files(spark, sf_dir):
    """Captions written as caption files, those of an item turn about in two, read back, stored twice, and counted."""
    images, notes = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "conversations")
    folder, base = scratch_path(spark, "caption_files"), scratch_path(spark, "seeded")
    known = notes.join(images.withColumnRenamed("doc_id", "conv_id"), "conv_id", "left_semi").distinct()
    # A caption file is one JSON object, so there are as many as keep each small.
    bucket = F.pmod(F.xxhash64("id"), F.lit(-(-images.count() // 2000))).alias("bucket")
    parts = images.select(F.col("doc_id").alias("id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("file")).select("*", bucket)
    listed = parts.groupBy("file", "bucket").agg(F.collect_list(F.struct("id", F.col("id").cast("string").alias("file_name"))).alias("images"))
    told = known.select(F.col("conv_id").alias("id"), F.pmod("turn", F.lit(2)).cast("int").alias("file"), "text").select("*", bucket)
    annotated = told.groupBy("file", "bucket").agg(
        F.collect_list(F.struct(F.col("id").alias("image_id"), F.col("text").alias("caption"))).alias("annotations")
    )
    whole = listed.join(annotated, ["file", "bucket"], "left").select("images", F.coalesce("annotations", F.array()).alias("annotations"))
    whole.write.option("maxRecordsPerFile", 1).json(folder)
    for _ in range(2):
        items, captions = read_captioned_images(spark, folder, "set")
        items = items.select(F.col("id").cast("string").alias("id"), "dataset", F.lit(None).cast("binary").alias("content"))
        store_images(items, captions.withColumn("id", F.col("id").cast("string")), base)
    stored = read_captions(spark, base)
    per_item = stored.groupBy("id").agg(
        F.count("*").alias("n_captions"), F.countDistinct("text").alias("n_texts"), F.countDistinct("source").alias("n_files"), F.min("text").alias("first")
    )
    last = numbered_captions(stored).groupBy("id").agg(F.max("pos").alias("last"))
    counts = read_metadata(spark, base).select("id").join(per_item, "id", "left").join(last, "id", "left")
    zero = lambda name: F.coalesce(name, F.lit(0).cast("bigint")).alias(name)
    return counts.select(
        F.col("id").cast("bigint").alias("id"),
        zero("n_captions"),
        zero("n_texts"),
        zero("n_files"),
        F.when(F.col("last") + 1 == F.col("n_captions"), 1).otherwise(0).alias("captioned"),
        F.md5(F.coalesce("first", F.lit(""))).alias("first_text"),
    )


@query(
    """SELECT vec_id AS image_id, label FROM embeddings e
       WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = e.vec_id)"""
)
def ingest_orphans(spark, sf_dir):
    """Annotations that name an unknown image."""
    images = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    notes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "label")
    return orphan_annotations(images, notes).select("image_id", "label")


@query(
    """SELECT vec_id // 5 AS doc_id, CAST(vec_id % 5 AS INTEGER) AS pos, len(embedding) AS dim,
       round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS vec_sum FROM embeddings"""
)
def explode_features(spark, sf_dir):
    """Bags to features. Bags come from all documents; those without vectors are empty and give no rows."""
    features = picture_features(spark, sf_dir)
    bags = features.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "vec"))).alias("bag"))
    docs = table(spark, sf_dir, "documents").select("doc_id").join(bags, "doc_id", "left")
    docs = docs.select("doc_id", F.coalesce(F.col("bag.vec"), F.array().cast("array<array<float>>")).alias("vectors"))
    return explode_documents(docs).select(
        "doc_id",
        "pos",
        F.size("vec").cast("bigint").alias("dim"),
        F.round(F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x), 6).alias("vec_sum"),
    )


@query("SELECT len(embedding) AS dim, count(*) AS n FROM embeddings GROUP BY 1")
def feature_vectors(spark, sf_dir):
    """The vectors alone, counted by dimension."""
    vectors = vectors_of(picture_features(spark, sf_dir))
    return vectors.groupBy(F.size("vec").cast("bigint").alias("dim")).agg(F.count("*").alias("n"))


@query(
    """SELECT c_custkey AS id, source AS dataset, lang, n_chars
       FROM customer LEFT JOIN documents ON doc_id = c_custkey"""
)
def metadata_lookup(spark, sf_dir):
    """Metadata of many ids; nulls for an unknown one."""
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    metadata = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("dataset"), "lang", "n_chars"
    )
    return lookup(metadata, ids, "id")


@query("SELECT page_id AS id, '/images/' || page_id || '.jpg' AS path, octet_length(encode(html)) AS n_bytes FROM pages")
def image_paths(spark, sf_dir):
    """Path of a picture's file; the content is opaque bytes."""
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        F.col("page_id").alias("id"),
        image_path("/images", F.col("page_id")).alias("path"),
        F.octet_length("html").cast("bigint").alias("n_bytes"),
    )


@query(
    sql.with_ctes(
        sql.sparse_text("enc", "conversations", "conv_id, turn"),
        "SELECT conv_id, turn, bucket, round(w, 6) AS w FROM enc",
    )
)
def encode_hashed_text(spark, sf_dir):
    """Text as hashed word counts, L2-normalised, non-zero elements only."""
    turns = table(spark, sf_dir, "conversations")
    return hashed_term_weights(turns, ["conv_id", "turn"], DIM).withColumn("w", F.round("w", 6))


@query(
    sql.with_ctes(
        sql.sparse_text("enc", "conversations", "conv_id, turn"),
        "SELECT conv_id, turn, bucket, round(CAST(CAST(w AS FLOAT) AS DOUBLE), 6) AS w FROM enc",
    )
)
def encode_dense_text(spark, sf_dir):
    """The default encoder's vectors, opened again."""
    turns = table(spark, sf_dir, "conversations")
    encoded = encode_text(turns, hashed_words(DIM))
    elements = encoded.select("conv_id", "turn", F.posexplode("vec").alias("bucket", "w"))
    return elements.filter("w <> 0").withColumn("w", F.round(F.col("w").cast("double"), 6))


@query(
    sql.with_ctes(
        sql.sparse_text("enc", "benchmark", "item_id", unit="3-gram"),
        "SELECT item_id, bucket, round(w, 6) AS w FROM enc",
    )
)
def encode_char_ngrams(spark, sf_dir):
    """Test captions as hashed character 3-grams."""
    texts = table(spark, sf_dir, "benchmark")
    return hashed_term_weights(texts, ["item_id"], DIM, tokens=char_ngrams).withColumn("w", F.round("w", 6))


def _docs_and_log(spark, sf_dir):
    """Labelled documents count as sampled: those of good quality for tree blue, the others for green."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("dataset"))
    log = table(spark, sf_dir, "labels").select(
        "doc_id",
        F.when(F.col("quality") == 1, "blue").otherwise("green").alias("tree_id"),
        F.lit("captions").alias("namespace"),
    )
    return docs, log


_UNSAMPLED = "documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)"


@query(
    f"""SELECT doc_id, source AS dataset FROM {_UNSAMPLED} AND {sql.fraction("'sample:blue:' || doc_id")}
        < least(300.0 / (SELECT count(*) FROM {_UNSAMPLED}), 1.0)"""
)
def sample_new_docs(spark, sf_dir):
    """About 300 of the documents that tree blue has not seen."""
    docs, log = _docs_and_log(spark, sf_dir)
    return sample_next(docs, log, 300, "blue", "captions")


@query(f"SELECT doc_id, source AS dataset FROM {_UNSAMPLED}")
def unsampled_docs(spark, sf_dir):
    docs, log = _docs_and_log(spark, sf_dir)
    return unsampled(docs, log, "blue", "captions")


@query(f"SELECT count(*) AS remaining FROM {_UNSAMPLED}")
def unsampled_docs_count(spark, sf_dir):
    docs, log = _docs_and_log(spark, sf_dir)
    return unsampled_count(docs, log, "blue", "captions")


@query(
    """SELECT dataset, remaining, round(least(20.0 / remaining, 1.0), 6) AS of_20,
       round(least((remaining / 100.0 + 1) / remaining, 1.0), 6) AS of_one_percent,
       round(least(1000000.0 / remaining, 1.0), 6) AS of_more
       FROM (SELECT source AS dataset, count(*) AS remaining FROM documents GROUP BY 1)"""
)
def sample_size_rule(spark, sf_dir):
    """Sample ratio for several sizes, per data set."""
    counts = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("dataset")).agg(F.count("*").alias("remaining"))
    left = F.col("remaining")
    return counts.select(
        "dataset",
        "remaining",
        F.round(sample_ratio(20, left), 6).alias("of_20"),
        F.round(sample_ratio(-1, left), 6).alias("of_one_percent"),
        F.round(sample_ratio(1_000_000, left), 6).alias("of_more"),
    )


@query(
    f"""SELECT doc_id, source AS dataset FROM documents WHERE doc_id % 3 = 0 AND doc_id NOT IN
        (SELECT doc_id FROM labels WHERE quality = 1)"""
)
def unsampled_docs_of_batch(spark, sf_dir):
    """Of a batch of documents, those that the log does not list."""
    docs, log = _docs_and_log(spark, sf_dir)
    return unsampled_of_batch(docs.filter(F.col("doc_id") % 3 == 0), log, "blue", "captions")


@query("SELECT doc_id, 'blue' AS tree_id, 'captions' AS namespace, true AS in_time FROM documents")
def sample_log_entries(spark, sf_dir):
    """What is noted of sampled documents, the time being that of the job."""
    entries = log_entries(table(spark, sf_dir, "documents"), "blue", "captions")
    age = F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("sampled_at")
    return entries.select("doc_id", "tree_id", "namespace", F.abs(age).between(0, 3600).alias("in_time"))


def _descriptors(content):
    """A stand-in for a descriptor extractor: length and first byte, length and last byte; nothing of an empty picture."""
    return [[float(len(content)), float(content[0])], [float(len(content)), float(content[-1])]] if content else None


@query(
    """WITH p AS (SELECT page_id, encode(html) AS b FROM pages WHERE octet_length(encode(html)) > 0)
       SELECT page_id AS doc_id, 0 AS pos, CAST(octet_length(b) AS DOUBLE) AS size, CAST(CAST('0x' || hex(b)[1:2] AS BIGINT) AS DOUBLE) AS byte FROM p
       UNION ALL SELECT page_id, 1, CAST(octet_length(b) AS DOUBLE), CAST(CAST('0x' || hex(b)[-2:] AS BIGINT) AS DOUBLE) FROM p"""
)
def extracted_features(spark, sf_dir):
    """Bytes to bags of vectors by the user's function, run over Arrow batches."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.encode("html", "UTF-8").alias("content"))
    features = extract_features(pages, _descriptors)
    return features.select(
        "doc_id", "pos", F.get("vec", F.lit(0)).cast("double").alias("size"), F.get("vec", F.lit(1)).cast("double").alias("byte")
    )
