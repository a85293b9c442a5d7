"""Stages of the pipeline and whole-row operators on inputs whose columns have the operators' own names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lorestone.llm import decontaminate, media, mixing, neardup, sharding, toxicity

NAMES = ("toxic_score", "__source", "__size", "__copies", "__u", "__row", "__hits", "__key", "size", "node", "part", "uid", "cls", "found", "row_key", "component", "n", "y", "__id", "grp")


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, f"word{i} alpha beta gamma delta epsilon {i}", "en", f"s{i % 2}", 9) for i in range(30)] + [(None, None, None, None, None), (3, "word3 alpha beta gamma delta epsilon 3", "en", "s1", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({n: F.lit(f"own {n}") for n in NAMES})


def test_toxicity(spark, clashing):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    out = toxicity.drop_toxic(clashing, labels, threshold=2.0)
    assert out.columns == clashing.columns and out.count() == clashing.count()
    assert out.select("toxic_score").distinct().collect()[0][0] == "own toxic_score"


def test_near_duplicates(clashing):
    out = neardup.keep_one(clashing)
    assert out.columns == clashing.columns and out.count() == 31 and out.filter("doc_id = 3").count() == 1


@pytest.mark.parametrize("blocks", [1, 3])
def test_decontamination(spark, clashing, blocks, monkeypatch):
    if blocks > 1:
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 12)
    items = spark.createDataFrame([(k, " ".join(f"item{k}x{j}" for j in range(10))) for k in range(3)], "item_id long, text string")
    dirty = clashing.withColumn("text", F.concat("text", F.lit(" item1x0 item1x1 item1x2 item1x3 item1x4 item1x5 item1x6 item1x7 item1x8 item1x9 "), "text"))
    out = decontaminate.clean(dirty, items)
    assert out.columns == clashing.columns and out.count() == 32 and out.filter("text like '%item1x%'").count() == 0


def test_mixing(clashing):
    out = mixing.emit(clashing)
    assert out.columns == clashing.columns and out.count() > 0 and out.select("__source").distinct().collect()[0][0] == "own __source"


def test_sharding(clashing):
    out = sharding.shard_documents(clashing.withColumns({"Shard": F.lit("x"), "slot": F.lit("y")}), 4)
    assert out.columns == [*clashing.columns, "shard", "slot"] and out.count() == 32 and {r.shard for r in out.collect()} == {0, 1, 2, 3}


def test_ids_of_other_types_and_plain_folders(spark, tmp_path):
    docs = spark.createDataFrame([(1.5, "one"), (2.5, None)], "doc_id double, text string")
    assert {r.doc_id for r in media.media_report(docs, str(tmp_path / "shards")).collect()} == {1.5, 2.5}
    assert list((tmp_path / "shards").glob("*.tar")) and media.qualified(spark, "hdfs://h/x") == "hdfs://h/x" and media.qualified(spark, "/x/y") == "file:///x/y"
