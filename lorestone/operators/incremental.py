"""What changed since the last run: rules, file states, the manifest and the embedding cache."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorestone.functions.text import glob_pattern


@dataclass(frozen=True)
class Rule:
    name: str
    glob: str
    exclude: bool = False
    labels: tuple[str, ...] = field(default=())
    split_level: str | None = None


def merge_rules(general: Sequence[Rule], local: Sequence[Rule]) -> list[Rule]:
    """Local rules take the places of general ones of their name; others follow."""
    own = {r.name: r for r in local}
    names = {r.name for r in general}
    return [own.get(r.name, r) for r in general] + [r for r in local if r.name not in names]


def excluded(path: Column, rules: Sequence[Rule], watcher: bool = False) -> Column:
    """Whether any exclude rule matches, in whatever order the rules come."""
    hit = F.lit(False)
    for r in rules:
        if r.exclude:
            hit = hit | path.rlike(glob_pattern(r.glob, watcher))
    return hit


def first_rule(path: Column, rules: Sequence[Rule], watcher: bool = False) -> Column:
    """The name of the first include rule that matches, or null. A chain of conditions: no join."""
    found = F.lit(None).cast("string")
    for r in reversed([r for r in rules if not r.exclude]):
        found = F.when(path.rlike(glob_pattern(r.glob, watcher)), F.lit(r.name)).otherwise(found)
    return found


def rule_labels(path: Column, rules: Sequence[Rule]) -> Column:
    """The labels of the first include rule that matches; none if no rule does."""
    found = F.array().cast("array<string>")
    for r in reversed([r for r in rules if not r.exclude]):
        found = F.when(path.rlike(glob_pattern(r.glob)), F.array(*map(F.lit, r.labels)).cast("array<string>")).otherwise(found)
    return found


def assign_rules(files: DataFrame, rules: Sequence[Rule], path: str = "path") -> DataFrame:
    return files.filter(~excluded(F.col(path), rules)).withColumn("rule", first_rule(F.col(path), rules)).filter(F.col("rule").isNotNull())


def watched(path: Column, rules: Sequence[Rule], own_folder: str = ".lorestone/") -> Column:
    """Whether a changed path matters: no editor's temporary file, not of our own, and included."""
    return ~path.rlike(r"(\.swp|\.swo|\.tmp|~)$") & ~path.startswith(own_folder) & ~excluded(path, rules, True) & first_rule(path, rules, True).isNotNull()


def diff_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Each path's state: new, same_time, same_content, changed or deleted. One full outer join.

    ``files(path, content_hash, mtime)``, ``manifest(path, content_hash, mtime)``.
    """
    old = manifest.select("path", F.col("content_hash").alias("old_hash"), F.col("mtime").alias("old_mtime"), F.lit(True).alias("known"))
    both = files.withColumn("found", F.lit(True)).join(old, "path", "full")
    state = (
        F.when(F.col("found").isNull(), "deleted")
        .when(F.col("known").isNull(), "new")
        .when(F.col("mtime").eqNullSafe(F.col("old_mtime")), "same_time")
        .when(F.col("content_hash").eqNullSafe(F.col("old_hash")), "same_content")
        .otherwise("changed")
    )
    return both.select("path", state.alias("state"))


def upsert(table: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table with rows of the keys in ``changes`` replaced; new keys are added. Of a key's rows in one batch one
    stays, the same on every run; ``latest`` before says which."""
    said = F.xxhash64(*[F.array_sort(F.map_entries(c)) if changes.schema[c].dataType.typeName() == "map" else F.col(c) for c in changes.columns])
    one = latest(changes, keys, [said])
    return table.join(one.select(*keys), list(keys), "left_anti").unionByName(one)


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the order: each task passes on one row of a key only, so a key with most rows stays
    cheap."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__place", place).filter("__place = 1").drop("__place")


def previous(history: DataFrame) -> DataFrame:
    """``history(file_path, content_hash, state, version, ...)`` with what the file was in the version before, if it was there."""
    before = W.partitionBy("file_path").orderBy("version")
    was = F.lag(F.when(F.col("state") != "deleted", F.col("content_hash"))).over(before)
    return history.withColumn("previous_hash", was).withColumn("previous_version", F.lag("version").over(before))


def as_of(history: DataFrame, version: int) -> DataFrame:
    """The files as a version of the manifest had them."""
    last = latest(history.filter(F.col("version") <= version), ["file_path"], [F.desc("version")])
    return last.filter("state <> 'deleted'").select("file_path", "content_hash", "mtime", "chunk_count")


def changed_between(history: DataFrame, after: int, until: int) -> DataFrame:
    """``(file_path, state)`` of files that two versions have differently: new, deleted, changed."""
    at = lambda v, mark: as_of(history, v).withColumnRenamed("file_path", "path").withColumn("mtime", F.lit(mark))  # noqa: E731  content alone counts
    return diff_files(at(until, 1.0), at(after, 0.0)).filter("state in ('new', 'deleted', 'changed')").withColumnRenamed("path", "file_path")


def touch_mtime(manifest: DataFrame, times: DataFrame) -> DataFrame:
    """New mtimes for known paths; all else stays, unknown paths are ignored."""
    new = times.select("path", F.col("mtime").alias("new_mtime"))
    return manifest.join(new, "path", "left").withColumn("mtime", F.coalesce("new_mtime", "mtime")).drop("new_mtime")


def cache_lookup(texts: DataFrame, cache: DataFrame, model: str, dimensions: int) -> DataFrame:
    """``texts(key, text)`` with their hash and vector; another size of vector is a miss."""
    held = cache.filter((F.col("model") == model) & (F.col("dimensions") == dimensions)).select("content_hash", "vector")
    return texts.withColumn("content_hash", F.sha2("text", 256)).join(held, "content_hash", "left").withColumn("hit", F.col("vector").isNotNull())


def cache_touch(cache: DataFrame, hits: DataFrame, now: Column) -> DataFrame:
    seen = hits.filter("hit").select("content_hash").distinct().withColumn("seen", F.lit(True))
    return cache.join(seen, "content_hash", "left").withColumn("accessed_at", F.when(F.col("seen"), now).otherwise(F.col("accessed_at"))).drop("seen")


def cache_put(cache: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    one = F.min(F.struct("dimensions", "vector")).alias("x")  # of two vectors of one text always the same one
    fresh = rows.groupBy("content_hash", "model").agg(one).select("content_hash", "model", "x.*").withColumn("created_at", now).withColumn("accessed_at", now)
    return upsert(cache, fresh, ["content_hash", "model"])


def cache_prune(cache: DataFrame, older_than_ms: int, now: Column) -> DataFrame:
    """What stays: rows that were used within the time, up to its very end."""
    return cache.filter(F.col("accessed_at") >= now - F.lit(older_than_ms))


def cache_clear(cache: DataFrame, model: str | None = None) -> DataFrame:
    """What stays once a model's rows, or all, are gone."""
    return cache.filter(F.col("model") != model) if model is not None else cache.limit(0)


def cache_stats(cache: DataFrame, model: str = "model", vector: str = "vector") -> DataFrame:
    """Entries of each model and bytes of their vectors, of 4 bytes a number; a null model is the sum of all."""
    size = (F.sum(F.size(vector)) * 4).alias("bytes") if vector in cache.columns else F.lit(None).cast("long").alias("bytes")
    return cache.rollup(model).agg(F.count("*").alias("entries"), size)


def job_counters(states: DataFrame) -> DataFrame:
    """One row of ``states(state, chunks, hits, misses)``, a row a file: what a job did, and its cache hit rate."""
    of = lambda *names: F.count_if(F.col("state").isin(*names))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    done = states.agg(
        of("new", "changed", "same_time", "same_content").alias("files_total"), of("new", "changed").alias("files_processed"), of("same_time", "same_content").alias("files_skipped"),
        of("deleted").alias("files_deleted"), total("chunks").alias("chunks_created"), total("hits").alias("cache_hits"), total("misses").alias("cache_misses"),
    )
    return done.withColumn("cache_hit_rate", hit_rate(F.col("cache_hits"), F.col("cache_misses")))


def job_records(log: DataFrame) -> DataFrame:
    """One row a job of ``log(job_id, job_type, status, at, error, ...)``, where each change of its status is a row: its last status, and when
    it began and ended."""
    rest = [c for c in log.columns if c not in ("job_id", "job_type", "status", "at")]
    last = F.max(F.struct("at", (F.col("status") != "running").alias("over"), "status", *rest)).alias("x")
    rows = log.groupBy("job_id", "job_type").agg(F.min("at").alias("created_at"), last)
    return rows.select("job_id", "job_type", "x.status", "created_at", F.when(F.col("x.over"), F.col("x.at")).alias("finished_at"), *[f"x.{c}" for c in rest])


def last_finished_job(jobs: DataFrame) -> DataFrame:
    """Of ``jobs(job_id, status, created_at, finished_at, ...)`` the completed one that ended last, with its hit rate."""
    done = jobs.filter("status = 'completed'").orderBy(F.coalesce("finished_at", "created_at").desc_nulls_last(), F.desc("job_id")).limit(1)
    return done.withColumn("cache_hit_rate", hit_rate(F.col("cache_hits"), F.col("cache_misses")))


def current_job(jobs: DataFrame) -> DataFrame:
    return jobs.filter("status = 'running'").orderBy(F.desc("created_at"), F.desc("job_id")).limit(1)


def status(chunks: DataFrame, jobs: DataFrame, cache: DataFrame) -> DataFrame:
    """One row: documents, chunks, the running job, cache entries and the last finished job's hit rate."""
    sides = (
        chunks.agg(F.count_distinct("file_path").alias("documents"), F.count("*").alias("chunks")),
        current_job(jobs).agg(F.max("job_id").alias("current_job")),
        cache.agg(F.count("*").alias("cache_entries")),
        last_finished_job(jobs).agg(F.max("cache_hit_rate").alias("last_hit_rate")),
    )
    out = sides[0]
    for side in sides[1:]:
        out = out.crossJoin(F.broadcast(side))  # each is one row
    return out


#: Of a sketch's registers; with 12 an estimate is off by 1.6 % in two of three cases, and small numbers are exact.
SKETCH_BITS = 12


def sketched(rows: DataFrame, part: Column, key: str) -> DataFrame:
    """``(part, keys, n)``: a sketch of the distinct keys of each part of a table, and its rows."""
    return rows.groupBy(part.alias("part")).agg(F.hll_sketch_agg(key, F.lit(SKETCH_BITS)).alias("keys"), F.count("*").alias("n"))


def from_sketches(sketches: DataFrame) -> DataFrame:
    """One row: about how many distinct keys all parts have together, and how many rows. Reads nothing but the sketches."""
    union = F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("keys")), F.lit(0))
    return sketches.agg(union.alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def hit_rate(hits: Column, misses: Column) -> Column:
    return hits / F.nullif(hits + misses, F.lit(0))
