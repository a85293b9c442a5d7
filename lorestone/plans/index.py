"""The index job: from a folder of files to the tables of a knowledge base.

All tables but the two logs are in buckets, so a run rewrites what it touches and a run without changes writes nothing but its job record.
The manifest is written last: what a run did not finish is done again by the next one. What a dead writer
may have left half changed is settled at the start and built anew."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorestone.model import ANNOTATIONS, CACHE, CHUNKS, EDGES, MANIFEST, NODES, document_id
from lorestone.operators import graph, incremental, kb, store
from lorestone.operators.incremental import Rule
from lorestone.sources import embed, files, parsers
from lorestone.sources.scratch import written

CHUNK_COLUMNS = [c.split()[0] for c in CHUNKS.split(", ")]
MEMBERS = "doc_id string, id string"
KBS = "name string, project_root string, tags array<string>, metadata_json string, created_at bigint, updated_at bigint"
HISTORY = "file_path string, content_hash string, mtime double, chunk_count int, state string, version bigint, at bigint"
JOBS = "job_id string, job_type string, status string, at bigint, error string, files_total bigint, files_processed bigint, files_skipped bigint, files_deleted bigint, chunks_created bigint, cache_hits bigint, cache_misses bigint"
COUNTERS = [c.split()[0] for c in JOBS.split(", ")[5:]]


@dataclass(frozen=True)
class Home:
    """The tables of a knowledge base under one folder."""

    spark: SparkSession
    root: str
    buckets: int = 16

    def table(self, name: str) -> store.Buckets:
        schema, key = {
            "chunks": (CHUNKS, "file_path"), "manifest": (MANIFEST, "file_path"), "cache": (CACHE, "content_hash"), "nodes": (NODES, "id"), "edges": (EDGES, "from_id"),
            "members": (MEMBERS, "doc_id"), "annotations": (ANNOTATIONS, "id"), "kbs": (KBS, "name"),
            "sketches": ("place string, table_name string, keys binary, n bigint", "place"),
        }[name]
        return store.Buckets(self.spark, f"{self.root}/{name}", schema, key, 1 if name in ("kbs", "sketches") else self.buckets)

    def log(self, name: str, schema: str) -> DataFrame:
        """A table that is only added to."""
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}") if store.names_in(self.spark, self.root, name) else self.spark.createDataFrame([], schema)

    def history(self) -> DataFrame:
        """What became of each file in each version of the manifest. A run that died before it wrote the manifest and
        was run again has two rows for one version: the later one counts."""
        done = self.log("history", HISTORY).filter(F.col("version") <= self.table("manifest").version())
        return incremental.latest(done, ["file_path", "version"], [F.desc("at"), F.desc("content_hash")])

    def status(self) -> DataFrame:
        """One row: documents (an estimate), chunks, cached embeddings, the running job and the last one's hit rate. Reads the
        folders' sketches and the jobs' records, never chunks."""
        held, jobs = self.table("sketches").read(), self.jobs()
        chunks = incremental.from_sketches(held.filter("table_name = 'chunks'")).select(F.col("keys").alias("documents"), F.col("n").alias("chunks"))
        cache = incremental.from_sketches(held.filter("table_name = 'cache'")).select(F.col("n").alias("cache_entries"))
        now = incremental.current_job(jobs).agg(F.max("job_id").alias("current_job"))
        last = incremental.last_finished_job(jobs).agg(F.max("cache_hit_rate").alias("last_hit_rate"))
        return chunks.crossJoin(cache).crossJoin(now).crossJoin(last)  # each is one row

    def sketch(self, since: dict[str, int]) -> None:
        """Bring the sketches of some tables' folders up to their newest versions, from those in ``since``: only what was touched since is read."""
        sketches, rows, gone = self.table("sketches"), None, []
        sketches.settle()
        for name, version in since.items():
            table = self.table(name)
            touched = sorted({b for v in range(version + 1, table.version() + 1) for b in table.changes(v)})
            if touched:
                place = F.concat(F.lit(f"{name}:"), table.place(F.col(table.key)).cast("string"))
                own = incremental.sketched(table.read(touched), place, table.key).select(F.col("part").alias("place"), F.lit(name).alias("table_name"), "keys", "n")
                rows = own if rows is None else rows.union(own)
                gone += [(f"{name}:{b}",) for b in touched]
        if rows is not None:
            sketches.replace(written(rows), sketches.version(), self.spark.createDataFrame(gone, "place string"))

    def jobs(self) -> DataFrame:
        """One row a job, by its last record."""
        return incremental.job_records(self.log("jobs", JOBS))


def index(
    spark: SparkSession, root: str, rules: Sequence[Rule], name: str, home: str, embedder: embed.Embedder, model: str, dimensions: int, now: Column, tracked: DataFrame | None = None,
    ignored: bool = True, with_graph: bool = True, buckets: int = 16,
) -> DataFrame:
    """Bring the tables under ``home`` up to the files under ``root``: one row of counters, which the job's record keeps too.

    Files that ignore rules exclude are not listed unless ``ignored`` is false. Files of the manifest that are gone lose their chunks, so
    deletions need no event. If there are no chunks but a manifest, as after a lost table, everything is indexed anew.
    Only new and changed files are parsed, and only texts that the cache lacks are embedded. ``now`` is a number of
    milliseconds."""
    at = Home(spark, home, buckets)
    job = uuid.uuid4().hex
    _record(at, job, "running")
    try:
        counters = _index(at, root, rules, name, embedder, model, dimensions, now, tracked, ignored, with_graph).first()
    except Exception as e:
        _record(at, job, "failed", error=f"{type(e).__name__}: {e}"[:1000])
        raise
    _record(at, job, "completed", **{c: counters[c] for c in COUNTERS})
    return spark.createDataFrame([tuple(counters)], f"{', '.join(f'{c} bigint' for c in COUNTERS)}, cache_hit_rate double")


def _record(at: Home, job: str, status: str, error: str | None = None, **counters: int) -> None:
    stamp = at.spark.range(1).select(F.unix_millis(F.current_timestamp())).first()[0]
    row = (job, "index", status, stamp, error, *(counters.get(c) for c in COUNTERS))
    at.spark.createDataFrame([row], JOBS).coalesce(1).write.mode("append").parquet(f"{at.root}/jobs")


def _index(at: Home, root: str, rules: Sequence[Rule], name: str, embedder: embed.Embedder, model: str, dimensions: int, now: Column, tracked: DataFrame | None, ignored: bool, with_graph: bool) -> DataFrame:
    spark = at.spark
    chunks, manifest, cache = at.table("chunks"), at.table("manifest"), at.table("cache")
    lost = {t.root: t.settle() for t in (chunks, manifest, cache)}
    versions = {t.root: t.version() for t in (chunks, manifest, cache)}
    old = _known(chunks, manifest, [*lost[chunks.root], *lost[manifest.root]])
    listed = files.listing(spark, root, ignored, rules, tracked)
    listed = written(listed if tracked is None else listed.join(tracked.select("path"), "path", "left_semi"))
    same = listed.join(old, ["path", "mtime"])  # a file of a known time is not read
    found = written(files.with_content(listed.join(same.select("path"), "path", "left_anti"), root).select("path", "content", "content_hash", "mtime"))
    seen = written(found.select("path", "content_hash", "mtime").unionByName(same.select("path", "content_hash", "mtime")))
    states = written(incremental.diff_files(seen, old))
    todo = states.filter("state in ('new', 'changed')").select("path")
    if states.filter("state <> 'same_time'").isEmpty():
        return incremental.job_counters(states.withColumns({c: F.lit(0) for c in ("chunks", "hits", "misses")}))
    modules = parsers.with_modules(found.join(todo, "path", "left_semi").select("path", "content"), parsers.package_roots(seen))
    parsed = written(parsers.parse(modules, name))
    rows = written(parsers.chunks_of(parsed, rules))
    texts = rows.select(F.col("chunk_id").alias("key"), F.col("content").alias("text"))
    held = cache.read(cache.touched(texts.select(F.sha2("text", 256).alias("content_hash"))))
    looked, changes = embed.looked_up(texts, held, model, dimensions, embedder, now)
    looked = written(looked.select(F.col("key").alias("chunk_id"), "vector", "hit"))
    cache.replace(written(changes), versions[cache.root], unique=["content_hash", "model"])
    fresh = written(store.with_vectors(rows.join(looked, "chunk_id").select(*CHUNK_COLUMNS), dimensions))
    gone = states.filter("state = 'deleted'").select(F.col("path").alias("file_path"))
    replaced = gone.union(todo.withColumnRenamed("path", "file_path"))
    chunks.replace(fresh, versions[chunks.root], replaced)
    at.sketch({t.root.rpartition("/")[2]: versions[t.root] - bool(lost[t.root]) for t in (cache, chunks)})  # what was settled is sketched too
    if with_graph:
        _into_graph(at, root, name, parsed, gone, now)
    counted = rows.join(looked.select("chunk_id", "hit"), "chunk_id").groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("chunks"), F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    counted = written(counted)
    touched = seen.join(states.filter("state <> 'same_time'"), "path").join(counted, "path", "left").join(old.select("path", "chunk_count"), "path", "left")
    entries = written(touched.select(F.col("path").alias("file_path"), "content_hash", "mtime", (now / 1000).cast("double").alias("indexed_at"), F.when(F.col("state") == "same_content", F.col("chunk_count")).otherwise(F.coalesce("chunks", F.lit(0))).cast("int").alias("chunk_count"), "state"))
    past = entries.unionByName(gone.withColumn("state", F.lit("deleted")), allowMissingColumns=True).withColumns({"version": F.lit(versions[manifest.root] + 1).cast("bigint"), "at": now.cast("bigint")})
    past.select(*[c.split()[0] for c in HISTORY.split(", ")]).write.mode("append").parquet(f"{at.root}/history")
    manifest.replace(entries.drop("state"), versions[manifest.root], gone)
    return incremental.job_counters(states.join(counted, "path", "left"))


def _known(chunks: store.Buckets, manifest: store.Buckets, lost: list[int]) -> DataFrame:
    """``(path, content_hash, mtime, chunk_count)`` of the files that need no work if they are as they were. In folders that a dead writer had touched all
    paths are known, by manifest or chunks, but not what they hold."""
    rows = manifest.read().select(F.col("file_path").alias("path"), "content_hash", "mtime", "chunk_count")
    if chunks.read().isEmpty():
        return rows.withColumns({"content_hash": F.lit(None).cast("string"), "mtime": F.lit(None).cast("double")})
    if not lost:
        return rows
    unsure = manifest.place(F.col("path")).isin(sorted(set(lost)))
    paths = rows.filter(unsure).select("path").union(chunks.read(sorted(set(lost))).select("file_path")).distinct()
    return rows.filter(~unsure).unionByName(paths, allowMissingColumns=True)


def _into_graph(at: Home, root: str, name: str, parsed: DataFrame, gone: DataFrame, now: Column) -> None:
    """Documents, what they hold and what relates to what; the knowledge base itself is registered first."""
    tables = {t: at.table(t) for t in ("nodes", "edges", "members", "annotations")}
    for t in (*tables.values(), at.table("kbs")):
        t.settle()
    versions = {t: table.version() for t, table in tables.items()}
    own = at.spark.createDataFrame([(name, root, [], None)], "name string, project_root string, tags array<string>, metadata_json string")
    kbs = at.table("kbs")
    if kbs.lookup(name).filter(F.col("project_root") == root).isEmpty():
        kbs.replace(kb.upsert_kbs(kbs.read(), own, now.cast("bigint")), kbs.version())
    held = {t: table.read() for t, table in tables.items()}
    stamp = F.timestamp_millis(now.cast("bigint"))
    docs = gone.select(document_id(F.lit(name), F.col("file_path")).alias("id"))
    if not docs.isEmpty():
        held = {t: written(df) for t, df in graph.delete_document(held["nodes"], held["edges"], held["members"], held["annotations"], docs, stamp).items()}
    held = graph.reconcile(held["nodes"], held["edges"], held["members"], held["annotations"], *map(written, for_reconcile(parsed, name)), stamp)
    for t, unique in (("nodes", ["id"]), ("edges", list(graph.EDGE_KEY)), ("annotations", ["id"]), ("members", ["doc_id", "id"])):
        tables[t].sync(written(held[t]), versions[t], unique)


def for_reconcile(parsed: DataFrame, kb: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, nodes with their document, and edges of parsed files, as ``graph.reconcile`` takes them."""
    docs = parsed.select("document.*").select("id", "label", F.lit(kb).alias("kb_name"), "properties")
    edges = parsers.edges_of(parsed)
    nodes = parsed.select(F.col("document.id").alias("doc_id"), F.explode("nodes").alias("n")).select("doc_id", "n.id", "n.label", F.lit(kb).alias("kb_name"), "n.properties")
    lacking = parsers.with_placeholders(nodes.drop("doc_id"), edges, kb).filter(F.col("properties")["placeholder"] == "true")
    owner = edges.join(parsed.select(F.explode("nodes.id").alias("from_id"), F.col("document.id").alias("doc_id")), "from_id").select("doc_id", F.col("to_id").alias("id")).distinct()
    nodes = nodes.unionByName(lacking.join(owner, "id").select("doc_id", "id", "label", "kb_name", "properties"))
    return docs, nodes, edges.withColumn("properties", F.create_map().cast("map<string,string>"))
