from collections import Counter

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from bagtree.llm import toxicity
from bagtree.llm.queries import QUERIES, SQL
from tests.llm.helpers import documents, rows
from tests.llm.test_decontaminate import ITEMS, planted
from tests.llm.test_near_duplicates import brute_classes


def test_stages_against_plain_versions(spark, tmp_path):
    items, data, leaked = planted()
    insults = [(50_000 + i, f"number {i} of many plain words here and {'rotter' if i % 3 == 0 else 'flower'} {i * 7}", "en", "s1", 1) for i in range(150)]
    data = data + insults
    documents(spark, data).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(n, t, "") for n, t in items.items()], ITEMS).write.parquet(str(tmp_path / "benchmark.parquet"))
    labels = [(i, 1, int(" rotter " in t)) for i, t, *_ in insults] + [(i, 1, 0) for i, *_ in data if i is not None and i < 40]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    left = [r for r in data if " rotter " not in (r[1] or "")]
    seen, docs = {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, function in corpus_pipeline.STAGES:
        function(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
        if name != "shards":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    assert Counter(map(tuple, seen["toxicity"])) == Counter(left)
    classes = brute_classes(left)
    unique = {i for i, c in classes.items() if i == c}
    assert sorted(r.doc_id for r in seen["near_duplicates"] if r.doc_id is not None) == sorted(unique)
    clean = sorted(unique - set(leaked))
    assert sorted(r.doc_id for r in seen["decontamination"] if r.doc_id is not None) == clean
    assert Counter(map(tuple, seen["mixture"])) == Counter(map(tuple, seen["decontamination"]))
    final = seen["shards"]
    assert Counter(tuple(r)[:5] for r in final) == Counter(map(tuple, seen["mixture"]))
    for shard in {r.shard for r in final}:
        slots = sorted(r.slot for r in final if r.shard == shard)
        assert slots == list(range(len(slots)))
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, whole)) == Counter(map(tuple, final))


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = documents(spark, rows()).where("false")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], ITEMS).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(queries()) and set(SQL) <= set(oracle_sql())
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert toxicity.SAMPLE_ROWS
