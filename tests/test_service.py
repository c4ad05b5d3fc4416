"""Ingest from files, then the whole service."""

import json
import random

import pytest
from pyspark.sql import functions as F

from bagtree.operators.features import extract_features
from bagtree.operators.tree import TreeShape
from bagtree.plans.service import NodeNotFound, SearchService
from bagtree.sources import captions as source
from bagtree.sources.scratch import stage

COLOURS = ("red", "green", "blue")


@pytest.fixture
def data_set(tmp_path):
    """Thirty pictures in three kinds; one has no caption."""
    images, notes = [], []
    folder = tmp_path / "pictures"
    folder.mkdir()
    for i in range(30):
        images.append({"id": i, "file_name": f"p{i}.jpg"})
        (folder / f"p{i}.jpg").write_bytes(bytes([i]) * 10)
        if i:
            notes += [{"image_id": i, "caption": f"a {COLOURS[i % 3]} thing"}, {"image_id": i, "caption": f"{COLOURS[i % 3]} number {i}"}]
    path = tmp_path / "captions.json"
    path.write_text(json.dumps({"images": images, "annotations": notes, "info": {"year": 1}}))
    return str(path), str(folder)


def test_caption_file(spark, data_set):
    items, captions = source.read_captioned_images(spark, data_set[0], "set")
    folded = {r["id"]: r for r in source.fold_captions(items, captions).collect()}
    assert len(folded) == 30 and folded[0]["captions"] == []
    assert folded[4]["captions"] == ["a green thing", "green number 4"] and folded[4]["dataset"] == "set"
    counts = {r["id"]: r["n_captions"] for r in source.caption_counts(items, captions).collect()}
    assert counts == {i: 2 if i else 0 for i in range(30)}


def caption_file(path, images, notes):
    listed = [{"id": i, "file_name": f"p{i}.jpg"} for i in images]
    path.write_text(json.dumps({"images": listed, "annotations": [{"image_id": i, "caption": c} for i, c in notes]}))


def test_captions_of_one_item_from_several_files(spark, tmp_path):
    """Places repeat over files; no caption is lost, and the item is one."""
    folder = tmp_path / "files"
    folder.mkdir()
    caption_file(folder / "a.json", [1, 2], [(1, "one"), (1, "two"), (2, "three")])
    caption_file(folder / "b.json", [1], [(1, "four"), (1, "two"), (1, "one")])
    items, captions = source.read_captioned_images(spark, str(folder), "set")
    assert sorted(r["id"] for r in items.collect()) == [1, 2]
    base = str(tmp_path / "store")
    items = items.select(F.col("id").cast("string").alias("id"), "dataset", F.lit(b"x").alias("content"))
    captions = captions.withColumn("id", F.col("id").cast("string"))
    for _ in range(2):
        source.store_images(items, captions, base)
        stored = {(r["id"], r["source"], r["text"]) for r in source.read_captions(spark, base).collect()}
        assert source.read_captions(spark, base).count() == len(stored) == 6
    numbered = source.numbered_captions(source.read_captions(spark, base)).orderBy("id", "pos").collect()
    assert [(r["id"], r["pos"], r["text"]) for r in numbered] == [
        ("1", 0, "one"), ("1", 1, "two"), ("1", 2, "four"), ("1", 3, "two"), ("1", 4, "one"), ("2", 0, "three"),
    ]


@pytest.mark.parametrize("indent, range_bytes", [(None, "64"), (1, "100"), (None, "128m")])
def test_a_caption_file_is_read_by_ranges(spark, tmp_path, indent, range_bytes):
    """Braces, quotes, backslashes and line ends in captions, however the ranges cut them."""
    rng = random.Random(7)
    bits = ["a", "}", "{", '"', "\\", "\n", "Ü", "中", " ", ",", "},{", '"}', "]}", '{"image_id": 3}', "x" * 90]
    images = [{"id": i, "file_name": f"p{i}}}.jpg", "license": i % 3} for i in range(40)]
    notes = [{"id": 1000 + i, "image_id": i % 40, "caption": "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))} for i in range(160)]
    whole = {"info": {"year": 1, "by": "}"}, "licenses": [{"url": "u", "id": 1, "name": "n"}], "images": images, "annotations": notes}
    path = tmp_path / "odd.json"
    path.write_text(json.dumps(whole, indent=indent, ensure_ascii=bool(indent)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", range_bytes)
    try:
        assert (spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 10) == (range_bytes != "128m")
        items, captions = source.read_captioned_images(spark, str(path), "set")
        assert {(r["id"], r["file_name"]) for r in items.collect()} == {(i["id"], i["file_name"]) for i in images}
        got = [(r["id"], r["text"]) for r in captions.orderBy("pos").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(n["image_id"], n["caption"]) for n in notes]


def test_new_captions_of_a_known_item(spark, tmp_path):
    base = str(tmp_path / "store")
    items = spark.createDataFrame([("i", "set", b"x")], "id string, dataset string, content binary")
    lines = lambda *texts: spark.createDataFrame([("i", n, t) for n, t in enumerate(texts)], "id string, pos int, text string")
    source.store_images(items, lines("a", "b"), base)
    source.store_images(items, lines("c", "b"), base)
    source.store_images(items, lines("a", "b"), base)
    assert sorted(r["text"] for r in source.read_captions(spark, base).collect()) == ["a", "b", "c"]
    assert source.read_metadata(spark, base).count() == 1
    folded = source.fold_captions(items.select("id"), source.read_captions(spark, base)).first()
    assert folded["captions"] == ["a", "c", "b"]


def test_orphan_caption_is_an_error(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"images": [{"id": 1, "file_name": "a"}], "annotations": [{"image_id": 2, "caption": "x"}]}))
    with pytest.raises(source.OrphanAnnotations):
        source.read_captioned_images(spark, str(path), "set")


def test_image_files_and_paths(spark, data_set):
    files = source.read_image_files(spark, data_set[1])
    row = files.filter("id = 'p7'").first()
    assert (row["file_name"], bytes(row["content"])) == ("p7.jpg", bytes([7]) * 10)
    ids = spark.createDataFrame([("p7",)], "id string")
    assert ids.select(source.image_path("/base/", F.col("id")).alias("p")).first()["p"] == "/base/p7.jpg"


def test_pictures_to_features(spark, data_set):
    """Any function of a picture's bytes serves; a picture that gives nothing has no features."""

    def extract(content):
        return [[content[0], 0.0], [0.0, len(content)]] if content[0] % 2 else None

    features = extract_features(source.read_image_files(spark, data_set[1]), extract)
    got = {(r["doc_id"], r["pos"]): r["vec"] for r in features.collect()}
    assert len(got) == 30 and got[("p7", 0)] == [7.0, 0.0] and got[("p7", 1)] == [0.0, 10.0]


@pytest.fixture
def service(spark, data_set, tmp_path):
    empty = spark.createDataFrame([], "doc_id string, pos int, vec array<float>")
    shape = TreeShape(k=3, levels=2, min_samples=6, iters=3)
    made = SearchService(spark, str(tmp_path / "store"), empty, shape=shape, threshold=0.0001)
    made.seed(*data_set, "set")
    kinds = made.captions().groupBy("id").agg(F.regexp_extract(F.min("text"), "red|green|blue", 0).alias("colour"))
    ids = made.metadata().join(kinds, "id", "left")
    # Three descriptors per picture; pictures of a kind look alike. The one without caption is like the green ones.
    base = F.when(F.col("colour") == "red", 0.0).when(F.col("colour") == "blue", 20.0).otherwise(10.0)
    features = ids.select(F.col("id").alias("doc_id"), base.alias("base"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("pos")).select(
        "doc_id", "pos", F.array((F.col("base") + F.col("pos") * 0.01), F.col("base")).cast("array<float>").alias("vec")
    )
    made.picture_features = stage(features, "features")
    return made


def test_service_from_files_to_quality(spark, service):
    metadata = service.metadata()
    assert metadata.count() == 30
    with_path = service.image_paths(metadata.select("id").limit(1)).first()
    assert with_path["path"].endswith(f"{with_path['id']}.jpg")
    assert service.metadata_of(spark.createDataFrame([("nobody",)], "id string")).first()["captions"] == []

    asked = spark.createDataFrame([("q1", "a red thing"), ("q2", "green number 4")], "query_id string, text string")
    with pytest.raises(NodeNotFound):
        service.query_labeled(asked, 3)

    service.train(15, 15)
    service.populate()
    assert service.populate() is False
    captions_of = {r["id"]: r["captions"] for r in service.metadata_of(metadata.select("id")).collect()}
    hits = service.query_labeled(asked, 5).collect()
    assert {r["query_id"] for r in hits} == {"q1", "q2"} and all(r["rank"] <= 5 for r in hits)
    best = {r["query_id"]: captions_of[r["doc_id"]] for r in hits if r["rank"] == 1}
    assert "red" in best["q1"][0]

    wide = service.query_all(asked, 30).collect()
    assert {r["query_id"] for r in wide} == {"q1", "q2"}

    quality = service.experiment(asked, ns=(1, 5)).collect()
    assert {(r["variant"], r["n"]) for r in quality} == {(v, n) for v in ("labeled_only", "all") for n in (1, 5)}
    assert all(r["mean_duration_sec"] > 0 and 0 <= r["mean_ndcg"] <= 1 for r in quality)

    # A second tree of each kind takes over, and the older ones go.
    before = {r["tree_id"] for r in service.caption_index.trees().collect()}
    service.train(20, 10**6)
    assert len(service.retire()) == 2
    assert not before & {r["tree_id"] for r in service.caption_index.trees().collect()}
    assert service.populate() is True
    assert service.query_labeled(asked, 5).count() > 0
