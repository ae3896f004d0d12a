"""The pipeline stage by stage over a small fixture, and its registration."""

import pytest

import __spark_entry__
import corpus_pipeline

from . import brute
from .test_texts import prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    passage, copy = prose(80), prose(150)
    texts = {i: prose(120) for i in range(60)} | {1000 + i: "BUY!!! NOW!!! " * (20 + i) for i in range(120)} | {2000 + i: prose(100) for i in range(120)} | {100 + i: copy for i in range(12)} | {120 + i: f"{prose(60)} {passage}" for i in range(6)} | {130: "", 131: None}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    labels = [(i, int(not 1000 <= i < 1120), 0) for i in texts if i not in (130, 131)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(stage(spark, tables[-1], folder).cache())
        if name != "packing":
            assert tables[-1].columns == docs.columns
    _, good, single, cut, packed = tables
    ids = [{r.doc_id for r in t.select("doc_id").collect()} for t in (good, single, cut)]
    assert not ids[0] & set(range(1000, 1120)) and set(range(60)) <= ids[0]
    assert ids[1] & set(range(100, 112)) == {100} and set(range(60)) <= ids[1]
    assert set(range(60)) <= ids[2] and set(range(120, 126)) <= ids[2]
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert sum(len(brute.words(texts[i])) > 100 for i in range(120, 126)) == 1
    assert {r.doc_id for r in packed.collect()} == ids[2]


def test_run_and_registration(spark, folder):
    assert "pipeline" in __spark_entry__.queries()
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_empty_tables_and_clashing_columns(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.limit(0), folder)
        assert none.count() == 0 and (name == "packing" or none.columns == docs.columns)
    odd = docs.where("doc_id in (0, 1, 100, 101, 120, 121, 130, 131)").selectExpr("*", "'r' as row", "1 as id", "'k' as digest", "2 as many", "'f' as first", "3 as node")
    odd = odd.unionByName(odd.where("doc_id = 0")).unionByName(odd.where("doc_id = 1").selectExpr("* except (doc_id)", "cast(null as long) as doc_id"))
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, odd, folder)
        assert out.count() > 0 and (name == "packing" or out.columns == odd.columns)
