"""Files, parsers, cache, graph changes and the stream, end to end on small fixtures."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lorestone import model
from lorestone.operators import graph, incremental, sync
from lorestone.sources import embed, files, parsers
from lorestone.streaming import watch

MD = "---\ntitle: Guide\n---\nintro\n# A\ntext\n## B\nmore\n```\n# not a heading\n```\n### C\ndeep\n## B\nagain\n"
PY = 'import os\nfrom pkg import auth\n\nclass Base:\n    """A base."""\n\nclass User(Base, Mixin):\n    def name(self):\n        return 1\n\ndef make():\n    return User()\n'
API = {"openapi": "3.0.0", "info": {"title": "T"}, "paths": {"/u": {"get": {"schema": {"$ref": "#/components/schemas/U"}}, "x-note": {}}}, "components": {"schemas": {"U": {"type": "object"}}}}


@pytest.fixture
def root(tmp_path):
    for name, text in {"docs/guide.md": MD, "docs/draft one.md": "# D\n", "src/pkg/user.py": PY, "src/pkg/auth.py": "x = 1\n", "src/bad.py": "def (", "api/a.json": json.dumps(API), "api/b.json": "[1]", "note.txt": "n"}.items():
        (tmp_path / "kb" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "kb" / name).write_text(text)
    return str(tmp_path / "kb")


RULES = [incremental.Rule("drafts", "**/draft*", exclude=True), incremental.Rule("docs", "docs/**/*.md", labels=("doc",)), incremental.Rule("all", "**")]


def test_discovery_and_parsers(spark, root):
    found = files.discover(spark, root, RULES)
    assert {r.path: r.rule for r in found.select("path", "rule").collect()} == {"docs/guide.md": "docs", "src/pkg/user.py": "all", "src/pkg/auth.py": "all", "src/bad.py": "all", "api/a.json": "all", "api/b.json": "all", "note.txt": "all"}
    tracked = spark.createDataFrame([("note.txt",)], "path string")
    assert files.discover(spark, root, RULES, tracked).count() == 1
    parsed = parsers.parse(found, "kb").cache()
    nodes = {r.id: r for r in parsers.nodes_of(parsed, "kb").collect()}
    assert {"kb::docs/guide.md::A > B", "kb::src.pkg.user.User.name", "kb::__unresolved__::Mixin", "kb::api/a.json::/u::get"} <= set(nodes)
    assert nodes["kb::src/bad.py"].properties["valid"] == "false" and nodes["kb::api/b.json"].properties["valid"] == "false"
    edges = {(r.from_id, r.to_id, r.rel_type, r.kind) for r in parsers.edges_of(parsed).collect()}
    assert ("kb::src.pkg.user", "kb::__external__::os", "RELATES", "imports") in edges
    assert ("kb::src.pkg.user.User", "kb::src.pkg.user.Base", "RELATES", "inherits_from") in edges
    assert ("kb::api/a.json::/u::get", "kb::api/a.json::components/schemas/U", "RELATES", "references") in edges
    assert ("kb::docs/guide.md::A", "kb::docs/guide.md::A > B", "CONTAINS", None) in edges
    crumbs = [r.header_breadcrumb for r in parsers.chunks_of(parsed).filter("file_path = 'docs/guide.md'").orderBy("chunk_index").collect()]
    assert crumbs == ["Document", "A", "A > B", "A > B > C", "A > B"]


def test_cache_embeds_each_miss_once(spark):
    texts = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "key int, text string")
    cache = spark.createDataFrame([], model.CACHE)
    done, cache = embed.through_cache(texts, cache, "m", 8, embed.hashed_words(8), F.lit(100).cast("long"))
    assert done.filter("vector is null").count() == 0 and cache.count() == 2
    again, cache2 = embed.through_cache(texts, cache, "m", 8, embed.hashed_words(8), F.lit(200).cast("long"))
    assert again.filter("hit").count() == 3 and {(r.created_at, r.accessed_at) for r in cache2.collect()} == {(100, 200)}
    assert incremental.cache_prune(cache2, 50, F.lit(250)).count() == 2 and incremental.cache_prune(cache2, 49, F.lit(250)).count() == 0


def test_rules_and_mtimes(spark):
    merged = incremental.merge_rules([incremental.Rule("a", "1"), incremental.Rule("b", "2")], [incremental.Rule("b", "3"), incremental.Rule("c", "4")])
    assert [(r.name, r.glob) for r in merged] == [("a", "1"), ("b", "3"), ("c", "4")]
    manifest = spark.createDataFrame([("p", "h", 1.0)], "path string, content_hash string, mtime double")
    got = incremental.touch_mtime(manifest, spark.createDataFrame([("p", 2.0), ("q", 3.0)], "path string, mtime double")).collect()
    assert [(r.path, r.mtime) for r in got] == [("p", 2.0)]
    assert files.read_rules('[{"ruleName": "r", "match": {"glob": "*"}, "labels": ["x"]}]') == [incremental.Rule("r", "*", False, ("x",))]


def test_annotations_follow_the_graph(spark):
    at = "timestamp '2024-01-01'"
    notes = spark.createDataFrame([("s1", "n1", "summary"), ("g1", "n2", "gotcha")], "id string, target_id string, kind string").selectExpr("*", f"{at} as created_at", f"{at} as updated_at")
    added = spark.createDataFrame([("s2", "n1", "summary"), ("s3", "n2", "summary")], "id string, target_id string, kind string").selectExpr("*", "timestamp '2025-01-01' as created_at", "timestamp '2025-01-01' as updated_at")
    got = {r.id: r for r in graph.annotate(notes, added, added.select(F.col("target_id").alias("id")))[0].collect()}
    assert set(got) == {"s1", "g1", "s3"} and got["s1"].created_at.year == 2024 and got["s1"].updated_at.year == 2025
    victims = spark.createDataFrame([("n2",)], "id string")
    left = {r.id: r.target_id for r in graph.orphan(notes, victims, F.current_timestamp()).collect()}
    assert left == {"s1": "n1", "g1": None}


def test_vocabularies_and_properties(spark):
    with pytest.raises(Exception, match="unknown kind"):
        spark.createDataFrame([("odd",)], "k string").select(model.checked(F.col("k"), model.ANNOTATION_KINDS, "kind")).collect()
    with pytest.raises(Exception, match="dimensions"):
        spark.range(1).select(model.checked_vector(F.array(F.lit(1.0)), 2)).collect()
    old = spark.createDataFrame([("a", "Class", "kb", {"x": "1", "y": "1"})], model.NODES)
    got = graph.upsert_nodes(old, spark.createDataFrame([("a", "Class", "kb", {"y": "2"})], model.NODES)).first()
    assert got.properties == {"x": "1", "y": "2"}


def test_three_way_and_drift(spark):
    side = lambda d: spark.createDataFrame(list(d.items()), "path string, hash string")
    got = {r.path: r.action for r in sync.three_way(side({"a": "2", "b": "2", "c": "1", "d": "1"}), side({"a": "1", "b": "x", "c": "1", "e": "1"}), side({"a": "1", "b": "1", "c": "1"})).collect()}
    assert got == {"a": "update", "b": "skip", "c": "same", "d": "install", "e": "leave"}
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert {(r.id, r.action) for r in sync.plan(ids("a", "b", "c"), ids("b", "c", "d")).collect()} == {("a", "upsert"), ("d", "delete")}
    assert sync.status(ids("a", "b"), None).first().drift == 2


def test_stream_indexes_new_files(spark, root, tmp_path):
    seen: list[str] = []
    stream = watch.changes(spark, root, RULES)
    query = watch.watch(stream, lambda batch: seen.extend(r.path for r in batch.select("path").collect()), str(tmp_path / "ck"), "0 seconds")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert "docs/guide.md" in seen and not any("draft" in p for p in seen)


def test_peers(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"name": "a", "pid": 1}')
    (tmp_path / "b.json").write_text('{"name": "b", "pid": 2}')
    peers = files.read_peers(spark, str(tmp_path), own="b")
    assert [(r.name, r.status) for r in files.peer_status(peers, spark.createDataFrame([(2,)], "pid long")).collect()] == [("a", "unreachable")]
