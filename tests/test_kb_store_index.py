"""Knowledge bases, links, annotations, stored tables and the index job, on small tables."""

from __future__ import annotations

import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lorestone import model
from lorestone.functions import text as tx
from lorestone.operators import graph, incremental, kb, search, store, sync
from lorestone.plans import index
from lorestone.sources import embed, parsers

KBS = "name string, project_root string, tags array<string>, metadata_json string, created_at int, updated_at int"
LINKS = "from_kb string, to_kb string, kind string, created_at int, metadata_json string"


def test_knowledge_bases_and_links(spark):
    old = spark.createDataFrame([("a", "/a", ["x"], "{}", 1, 1)], KBS)
    now = kb.upsert_kbs(old, spark.createDataFrame([("a", "/new", ["y"], None), ("b", "/b", [], "{}"), ("b", "/b", [], "{}")], "name string, project_root string, tags array<string>, metadata_json string"), F.lit(5))
    assert [(r.name, r.project_root, r.created_at, r.updated_at) for r in kb.list_kbs(now).collect()] == [("a", "/new", 1, 5), ("b", "/b", 5, 5)]
    assert [r.name for r in kb.list_kbs(now, tag="y").collect()] == ["a"] and kb.list_kbs(now, "c").count() == 0
    added = spark.createDataFrame([("a", "b", "mirrors", 7, "m"), ("a", "b", "mirrors", 8, "n"), ("a", "ghost", "mirrors", 7, "m"), (None, "b", "mirrors", 1, "m")], LINKS)
    links, lacking = kb.link_kbs(spark.createDataFrame([("a", "b", "mirrors", 2, "old")], LINKS), added, now)
    assert [tuple(r) for r in links.collect()] == [("a", "b", "mirrors", 2, "n")] and lacking.count() == 2
    assert kb.links_of(links, "b", "in").count() == 1 and kb.links_of(links, "b", "out").count() == 0
    assert kb.deleted(links, added, kb.LINK_KEY).first().deleted == 1 and kb.unlink(links, added).count() == 0
    left, no_links = kb.delete_kbs(now, links, now.filter("name = 'b'").select("name"))
    assert left.count() == 1 and no_links.count() == 0
    with pytest.raises(Exception, match="unknown kind of link"):
        kb.link_kbs(links, spark.createDataFrame([("a", "b", "odd", 7, "m")], LINKS), now)[0].collect()
    assert [(r.id, r.parent) for r in kb.roots(now, "a").collect()] == [("federation", None), ("a", "federation")]


def test_links_between_artifacts_merge_their_properties(spark):
    nodes = spark.createDataFrame([("a", "Class", "kb", {"qualname": "p.A"}), ("b", "Class", "kb", {})], model.NODES)
    old = spark.createDataFrame([("a", "b", "RELATES", "calls", {"x": "1", "author": "old"}), ("a", "b", "CONTAINS", None, {})], model.EDGES)
    schema = "from_id string, to_id string, kind string, author string, metadata_json string"
    edges, lacking = kb.link_artifacts(old, spark.createDataFrame([("a", "b", "calls", "me", None), ("a", "zz", "calls", "me", None), ("a", "b", None, "me", None)], schema), nodes)
    assert {(r.rel_type, r.kind): r.properties for r in edges.collect()} == {("RELATES", "calls"): {"x": "1", "author": "me"}, ("CONTAINS", None): {}} and lacking.count() == 2
    assert kb.relates_of(edges, "a").count() == 1 and kb.unlink_artifacts(edges, edges.select("from_id", "to_id", F.lit("calls").alias("kind"))).count() == 1
    assert kb.target_snapshot(nodes).filter("target_id = 'a'").first().target_snapshot == '{"target_id":"a","target_kind":"Class","breadcrumb":"p.A"}'
    assert [r[0] for r in spark.createDataFrame([("me", None), (" ", "cli"), (None, None)], "e string, c string").select(kb.author(F.col("e"), F.col("c"))).collect()] == ["me", "agent:cli", "user:unknown"]


def test_annotations_need_a_target_and_the_last_summary_counts(spark):
    schema = "id string, target_id string, kind string, created_at int"
    nodes = spark.createDataFrame([("n1",)], "id string")
    added = spark.createDataFrame([("s1", "n1", "summary", 1), ("s2", "n1", "summary", 2), ("g", "gone", "note", 1), ("k", "n1", "note", 1)], schema)
    first, lacking = graph.annotate(added.limit(0), added, nodes)
    assert [r.id for r in lacking.collect()] == ["g"]
    assert {r.id for r in first.collect()} == {"s2", "k"}
    again, _ = graph.annotate(first, spark.createDataFrame([("s3", "n1", "summary", 9)], schema), nodes)
    assert {(r.id, r.created_at) for r in again.collect()} == {("s2", 2), ("k", 1)}
    assert kb.delete_annotations(again, again.filter("id = 'k'")).count() == 1 and [r.id for r in kb.annotations_of(again, "n1").collect()] == ["k", "s2"]


def test_deleting_a_document_keeps_what_others_hold(spark):
    nodes = spark.createDataFrame([(i, "X", "kb", {}) for i in ("d", "e", "own", "shared", "below")], model.NODES)
    edges = spark.createDataFrame([("d", "own", "CONTAINS", None, {}), ("own", "below", "CONTAINS", None, {}), ("d", "shared", "CONTAINS", None, {})], model.EDGES)
    members = spark.createDataFrame([("d", "own"), ("d", "shared"), ("e", "shared")], "doc_id string, id string")
    notes = spark.createDataFrame([("n", "below", 0)], "id string, target_id string, updated_at int")
    out = graph.delete_document(nodes, edges, members, notes, spark.createDataFrame([("d",)], "id string"), F.lit(1))
    assert {r.id for r in out["nodes"].collect()} == {"e", "shared"} and out["edges"].count() == 0
    assert [(r.target_id, r.updated_at) for r in out["annotations"].collect()] == [(None, 1)]


def test_neighbors_give_the_edges_walked(spark):
    nodes = spark.createDataFrame([(i,) for i in "rabc"], "id string")
    edges = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "b"), ("b", "c")], "from_id string, to_id string")
    _, walked = graph.neighbors(nodes, edges, "r", 1)
    assert {tuple(r) for r in walked.select("from_id", "to_id").collect()} == {("r", "a"), ("r", "b")}
    _, walked = graph.neighbors(nodes, edges, "r", 2)
    assert walked.count() == 4 and graph.neighbors(nodes, edges, "r", 2, direction="in")[1].count() == 0


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "t")
    assert store.read(spark, root, model.MANIFEST).count() == 0
    rows = spark.createDataFrame([("a", "c1", [1.0, 2.0])], "file_path string, chunk_id string, vector array<float>")
    store.write(rows, root, 0)
    store.write(store.replace_documents(store.read(spark, root, ""), rows.withColumn("chunk_id", F.lit("c2")), rows.select("file_path"), 2), root, 1)
    with pytest.raises(store.Stale):
        store.write(rows, root, 1)
    assert [r.chunk_id for r in store.read(spark, root, "").collect()] == ["c2"] and len(store.snapshots(spark, root)) == 2
    for part in (tmp_path / "t" / "v00000002").glob("*.parquet"):
        part.write_bytes(b"damaged")
    for part in (tmp_path / "t" / "v00000002").glob(".*.crc"):
        part.unlink()
    assert [r.chunk_id for r in store.read(spark, root, "").collect()] == ["c1"]
    for bad in ([1.0], None):
        with pytest.raises(Exception, match="vector"):
            store.append_chunks(rows, rows.withColumn("vector", F.lit(bad).cast("array<float>") if bad is None else F.array(F.lit(1.0)).cast("array<float>")), 2).collect()
    assert store.evolved_chunks(rows.withColumn("header_breadcrumb", F.lit("h"))).first().section_breadcrumb == "h"
    assert store.restored(rows.withColumn("chunk_id", F.lit("")), ["chunk_id"]).first().chunk_id is None


def contents(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}


def test_buckets(spark, tmp_path):
    root = str(tmp_path / "t")
    table = store.Buckets(spark, root, "k string, n int, m map<string,string>", "k", 8)
    assert table.read().count() == 0 and table.version() == 0 and table.replace(table.read(), 0) == 0 and not Path(root, "_log").exists()
    rows = lambda *r: spark.createDataFrame([(k, n, {"x": str(n)}) for k, n in r], "k string, n int, m map<string,string>")
    first = table.replace(rows(*((f"k{i}", i) for i in range(40)), (None, -1)), 0)
    assert first == 1 and table.read().count() == 41 and store.Buckets(spark, root, table.schema, "k", 99).number == 8
    before = contents(root)
    second = table.replace(rows(("k3", 33)), first, rows(("gone", 0)).limit(0))
    changed = {p.split("/")[1] for p in before.items() ^ contents(root).items() for p in [p[0]]}
    assert second == 2 and len(changed) == 1 and table.changes(2) == [int(changed.pop().partition("=")[2])]
    assert [(r.n, r.m) for r in table.lookup("k3").collect()] == [(33, {"x": "33"})] and "PartitionFilters: [isnotnull(bucket" in table.lookup("k3")._jdf.queryExecution().toString()
    with pytest.raises(store.Stale):
        table.replace(rows(("k4", 0)), first)
    with pytest.raises(Exception, match="no"):
        table.replace(rows(("k4", 0)).withColumn("n", F.raise_error("no").cast("int")), second)
    assert table.version() == 2 and table.read().count() == 41  # a job that failed leaves nothing to settle
    third = table.replace(table.read().limit(0), second, table.read().select("k"))
    assert third == 3 and table.read().count() == 0 and not contents(root)
    fourth = table.sync(rows(("a", 1), ("b", 2), ("b", 3)), third, ["k", "n"])
    before = contents(root)
    assert table.sync(rows(("b", 3), ("b", 2), ("a", 1)), fourth, ["k", "n"]) == fourth and contents(root) == before
    assert table.sync(rows(("b", 2)), fourth, ["k", "n"]) == 5 and [(r.k, r.n) for r in table.read().collect()] == [("b", 2)]
    store._create(spark, f"{root}/_log/{6:010d}.claim", "[1, 2]")  # a writer that died
    with pytest.raises(store.Stale):
        table.replace(rows(("z", 1)), 5)
    assert table.settle() == [1, 2] and table.settle() == [] and table.replace(rows(("z", 1)), 6) == 7


RULES = [incremental.Rule("no", "**/skip*", exclude=True), incremental.Rule("docs", "**/*.md", labels=("docs",)), incremental.Rule("all", "**/*")]


def test_index_job(spark, tmp_path):
    root, home = tmp_path / "kb", str(tmp_path / "home")
    (root / "src" / "pkg").mkdir(parents=True)
    (root / "guide.md").write_text("# Guide\n\nHello.\n\n## Use\n\nMore.\n\n### Deep\n\n" + "Long words here. " * 900)
    (root / "src" / "pkg" / "__init__.py").write_text("from pkg.core import thing\nimport os\n")
    (root / "src" / "pkg" / "core.py").write_text('def thing(x: int = 1) -> int:\n    """Doc."""\n    return x\n')
    (root / "skip.md").write_text("# no")
    calls = []

    def run(at, with_graph=True):
        inner = embed.hashed_words(8)
        calls.append(at)
        return index.index(spark, f"file://{root}", RULES, "kb", home, inner, "hash", 8, F.lit(at), with_graph=with_graph).first()

    first = run(1)
    assert (first.files_total, first.files_processed, first.files_deleted, first.cache_hits) == (3, 3, 0, 0)
    chunks = index.Home(spark, home).table("chunks").read().filter("file_path = 'guide.md'").orderBy("chunk_index").collect()
    assert [c.header_breadcrumb for c in chunks[:3]] == ["Guide", "Guide > Use", "Guide > Use > Deep#part-1"] and all(c.labels == ["docs"] for c in chunks)
    assert chunks[2].section_breadcrumb == "Guide > Use > Deep" and chunks[2].parent_chunk_id == chunks[1].chunk_id and len(chunks) > 3
    assert [c.chunk_index for c in chunks] == list(range(len(chunks))) and all(len(c.vector) == 8 for c in chunks)
    at = index.Home(spark, home)
    assert at.table("kbs").lookup("kb").first().project_root == f"file://{root}" and at.table("nodes").read().filter("label = 'Function'").first().id == "kb::pkg.core.thing"
    assert {(r.from_id, r.to_id) for r in at.table("edges").read().filter("kind = 'imports'").collect()} == {("kb::pkg", "kb::pkg.core"), ("kb::pkg", "kb::__external__::os")}
    tables = [n for n in Path(home).iterdir() if n.name != "jobs"]
    before = {n.name: contents(n) for n in tables}
    again = run(2)
    assert (again.files_skipped, again.files_processed) == (3, 0) and {n.name: contents(n) for n in tables} == before
    (root / "guide.md").unlink()
    (root / "src" / "pkg" / "core.py").write_text("x = 1\n")
    assert [(r.documents, r.chunks, r.cache_entries, r.current_job) for r in at.status().collect()] == [(3, at.table("chunks").read().count(), at.table("cache").read().count(), None)]
    before = {n: contents(Path(home, n)) for n in ("chunks", "manifest")}
    third = run(3)
    assert (third.files_deleted, third.files_processed) == (1, 1)
    for n, held in before.items():
        assert len({p.split("/")[1] for p, _ in held.items() ^ contents(Path(home, n)).items()}) == 2  # one folder a file
    nodes = {r.id for r in at.table("nodes").read().collect()}
    assert "kb::guide.md" not in nodes and "kb::pkg.core.thing" not in nodes and "kb::pkg.core" in nodes
    past = incremental.previous(at.history())
    assert {(r.file_path, r.version, r.state, r.previous_hash is None) for r in past.collect()} == {("guide.md", 1, "new", True), ("src/pkg/__init__.py", 1, "new", True), ("src/pkg/core.py", 1, "new", True), ("guide.md", 2, "deleted", False), ("src/pkg/core.py", 2, "changed", False)}
    assert {r.file_path for r in incremental.as_of(at.history(), 1).collect()} == {"guide.md", "src/pkg/__init__.py", "src/pkg/core.py"}
    assert {tuple(r) for r in incremental.changed_between(at.history(), 1, 2).collect()} == {("guide.md", "deleted"), ("src/pkg/core.py", "changed")}
    assert [(r.status, r.files_processed) for r in at.jobs().orderBy("created_at").collect()] == [("completed", 3), ("completed", 0), ("completed", 1)]
    assert {r.file_path for r in index.Home(spark, home).table("manifest").read().collect()} == {"src/pkg/__init__.py", "src/pkg/core.py"}
    shutil.rmtree(Path(home) / "chunks")  # lost chunks: all is indexed anew, from the cache
    fourth = run(4, False)
    assert fourth.files_processed == 2 and fourth.cache_misses == 0 and fourth.cache_hit_rate == 1.0
    place = spark.range(1).select(at.table("chunks").place(F.lit("src/pkg/core.py"))).first()[0]
    shutil.rmtree(Path(home) / "chunks" / "data" / f"bucket={place}")  # a writer died within a commit: what it touched is built anew
    store._create(spark, f"{home}/chunks/_log/{at.table('chunks').version() + 1:010d}.claim", f"[{place}]")
    fifth = run(5, False)
    assert fifth.files_processed == 1 and at.table("chunks").lookup("src/pkg/core.py").count() > 0
    assert [(r.documents, r.chunks) for r in at.status().collect()] == [(2, at.table("chunks").read().count())]
    with pytest.raises(Exception, match="dimensions"):
        (root / "new.md").write_text("# new")
        index.index(spark, f"file://{root}", RULES, "kb", home, embed.hashed_words(4), "other", 8, F.lit(6))
    assert at.jobs().filter("status = 'failed' and error is not null").count() == 1


def test_package_roots_and_imports(spark):
    sources = [("src/pkg/__init__.py", "from pkg.core import thing\nfrom . import core\nimport os"), ("src/pkg/core.py", "from .sub import x\nclass A(B): pass"), ("src/pkg/sub/__init__.py", ""), ("tool.py", "import pkg")]
    rows = spark.createDataFrame(sources, "path string, content string")
    roots = parsers.package_roots(rows)
    assert [r.root for r in roots.collect()] == ["src"]
    named = parsers.with_modules(rows, roots)
    assert {r.path: r.module for r in named.collect()} == {"src/pkg/__init__.py": "pkg", "src/pkg/core.py": "pkg.core", "src/pkg/sub/__init__.py": "pkg.sub", "tool.py": "tool"}
    parsed = parsers.parse(named, "kb")
    nodes, edges = parsers.nodes_of(parsed, "kb"), parsers.edges_of(parsed)
    imports = {(r.from_id, r.to_id) for r in edges.filter("kind = 'imports'").collect()}
    assert imports == {("kb::pkg", "kb::pkg.core"), ("kb::pkg", "kb::pkg"), ("kb::pkg", "kb::__external__::os"), ("kb::pkg.core", "kb::pkg.sub"), ("kb::tool", "kb::pkg")}
    full = parsers.with_placeholders(nodes, edges, "kb")
    assert graph.with_both_ends(edges, full).count() == edges.count() and full.filter("id = 'kb::__external__::os'").first().label == "Module"
    docs, parts, links = index.for_reconcile(parsed, "kb")
    none = spark.createDataFrame([], "id string, target_id string, updated_at int")
    out = graph.reconcile(docs.limit(0), links.limit(0), parts.select("doc_id", "id").limit(0), none, docs, parts, links, F.lit(1))
    assert graph.with_both_ends(out["edges"], out["nodes"]).count() == links.count()


ODD = [
    '{"openapi": "3", "paths": {"/a": ["x"]}}', '{"openapi": "3", "info": "text"}', '{"openapi": "3", "components": ["x"]}', '{"openapi": "3", "components": {"schemas": ["x"]}}',
    '{"openapi": "3", "paths": {"/a": {"get": "text"}}}', "openapi: 3\nx: &a\n  y: *a\n", "openapi: 3\n2024-01-01: x\n", '["list"]', "{", "", "openapi: 3\ncomponents:\n  schemas:\n    A: &a {p: *a}\n",
]


def test_odd_files_do_not_kill_the_job(spark):
    def broken(text, kb_, path):
        raise RuntimeError("no")

    rows = spark.createDataFrame([(f"api/{i}.yaml", t) for i, t in enumerate(ODD)] + [("x.bad", "y"), ("n.md", None)], "path string, content string")
    got = {r.path: r for r in parsers.parse(rows, "kb", [(r"\.bad$", broken), *parsers.PARSERS]).collect()}
    assert len(got) == len(ODD) + 2 and got["x.bad"].document.properties["valid"] == "false" and got["x.bad"].document.properties["error"] == "RuntimeError"


def test_references_to_other_files(spark):
    a = '{"openapi": "3", "components": {"schemas": {"A": {"$ref": "../b.yaml#/components/schemas/B"}, "C": {"items": {"$ref": "#/components/schemas/A"}}, "D": {"$ref": "https://x.org/s.json"}}}}'
    b = '{"openapi": "3", "components": {"schemas": {"B": {"type": "object"}}}}'
    parsed = parsers.parse(spark.createDataFrame([("api/a.json", a), ("b.yaml", b)], "path string, content string"), "kb")
    edges = {(r.from_id.rpartition("/")[2], r.to_id) for r in parsers.edges_of(parsed).filter("kind = 'references'").collect()}
    assert edges == {("A", "kb::b.yaml::components/schemas/B"), ("C", "kb::api/a.json::components/schemas/A"), ("D", "kb::__external__::https://x.org/s.json")}


def test_small_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(tx.content_type(F.lit("||"))) == "text" and one(tx.content_type(F.lit("x\n|a|"))) == "table"
    assert one(tx.first_heading(F.lit("#\n\nfoo"))) == "foo" and one(tx.first_heading(F.lit("none"))) is None
    assert tx.glob_pattern("a/**") == "^a/.*$" and tx.glob_pattern("a/**?", watcher=True) == r"^a/[^/]*[^/]*\?$"
    assert one(tx.json_list(F.lit('["a"]'))) == ["a"] and one(tx.json_list(F.lit("{"))) == [] and one(tx.json_map(F.lit("no"))) == {} and one(tx.json_map(F.lit('{"a": "b"}'))) == {"a": "b"}
    assert one(tx.compatible(F.lit("1.2.3"), F.lit("1.9.0"))) and not one(tx.compatible(F.lit("x"), F.lit("1.9.0"))) and one(tx.is_identifier(F.lit("a_1"))) and not one(tx.is_identifier(F.lit("1a")))
    assert one(tx.utc(F.lit(0))).year in (1969, 1970)
    assert search.checked_request("q") == ("q", 20)
    for bad in (("", 5), ("q" * 501, 5), ("q", 101)):
        with pytest.raises(ValueError, match="query|search"):
            search.checked_request(*bad)


def test_search_by_text_peers_and_status(spark):
    embedder = embed.hashed_words(16)
    rows = [(f"c{i}", t, l, [float(x) for x in embedder([t])[0]]) for i, (t, l) in enumerate([("red fox", '["spec"]'), ("blue whale", '["specification", "x"]'), ("green tree", '["doc"]')])]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, labels_json string, vector array<double>")
    assert search.search_text(chunks, "red fox", embedder, "chunk_id", 1).first().chunk_id == "c0"
    assert search.search_text(chunks, "red fox", embedder, "chunk_id", 5, {"labels": ["spec", "x"]}).count() == 1
    with pytest.raises(ValueError, match="labels"):
        search.search_text(chunks, "red fox", embedder, "chunk_id", 1, {"path": ["x"]})
    jobs = spark.createDataFrame([("j1", "completed", 1, 5, 3, 1), ("j2", "completed", 2, 4, 0, 0), ("j3", "running", 3, None, 0, 0)], "job_id string, status string, created_at int, finished_at int, cache_hits int, cache_misses int")
    files = spark.createDataFrame([("a",), ("a",), ("b",)], "file_path string")
    assert tuple(incremental.status(files, jobs, files).first()) == (2, 3, "j3", 3, 0.75)
    assert incremental.cache_clear(files.withColumn("model", F.lit("m")), "m").count() == 0
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert {r.id for r in sync.applied(ids("a", "b", "b"), ids("b", "c")).collect()} == {"a", "b"}
    pivot = search.pivot_to_nodes(files.select(F.col("file_path").alias("artifact_qualname")), spark.createDataFrame([("a", "Class", "kb", {})], model.NODES))
    assert pivot.count() == 2
