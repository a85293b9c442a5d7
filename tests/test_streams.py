"""Streams with state: bursts over restarts, and a folder's changes with deletions."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from lorestone.streaming import debounce, folder, watch

EVENTS = "path string, ts timestamp, content_hash string"


@pytest.fixture
def rocks(spark):
    old = {k: spark.conf.get(k, None) for k in debounce.SETTINGS}
    for k, v in debounce.SETTINGS.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_bursts_survive_restarts(rocks, tmp_path):
    rng = random.Random(3)
    at, rows = 1_700_000_000_000, []
    for _ in range(60):
        at += rng.choice([100, 900, 1900, 2000, 2100, 5000])
        rows.append((rng.choice("abc"), at, f"h{at}"))
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    os.mkdir(source)
    end = [("end", at + 60_000, "x"), ("end", at + 120_000, "y")]
    for k, part in enumerate([rows[:20], rows[20:45], rows[45:], end[:1], end[1:]]):
        rng.shuffle(part)
        df = rocks.createDataFrame(part, "path string, ms bigint, content_hash string").select("path", F.timestamp_millis("ms").alias("ts"), "content_hash")
        df.coalesce(1).write.mode("append").parquet(source)
        stream = rocks.readStream.schema(EVENTS).parquet(source)
        query = debounce.debounced(stream, 2000, "10 seconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
        query.awaitTermination(120)  # each run is a restart
        assert query.exception() is None
    whole = rocks.read.schema(EVENTS).parquet(source).filter("path <> 'end'")
    want = {tuple(r) for r in watch.bursts(whole, "path").select("path", "began", "ended", "changes").collect()}
    got = [tuple(r) for r in rocks.read.parquet(out).filter("path <> 'end'").select("path", "began", "ended", "changes").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    last = {(r.path, r.ended): r.content_hash for r in rocks.read.parquet(out).collect()}
    assert all(last[p, e] == f"h{int(e.timestamp() * 1000) - 2000}" for p, _, e, _ in want)


def test_a_folder_as_table_and_stream(spark, tmp_path):
    root, state, marks = tmp_path / "kb", f"file://{tmp_path}/state", str(tmp_path / "marks")
    for name in ("top.md", "a/one.md", "a/b/two.md", "c/three.md", "_x/four.md"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    (root / "a" / "loop").symlink_to(root)
    spark.dataSource.register(folder.FolderSource)
    files = spark.read.format("folder").option("root", f"file://{root}").load()
    assert {r.path for r in files.collect()} == {"top.md", "a/one.md", "a/b/two.md", "c/three.md", "_x/four.md"}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    files = spark.read.format("folder").option("root", f"file://{root}").option("pushdown", "true").load()
    assert [r.path for r in files.filter("path = 'a/b/two.md'").collect()] == ["a/b/two.md"] and files.filter("mtime > 1e12").count() == 0
    assert {r.path for r in files.filter(F.col("path").startswith("a/")).collect()} == {"a/one.md", "a/b/two.md"}
    assert len(list(folder._Pushed(f"file://{root}").partitions())) == 4
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    seen = []
    stream = lambda: spark.readStream.format("folder").option("root", f"file://{root}").option("state", state).load()

    def run(change):
        """Start, let some listings pass, stop: the next start goes on from the kept ones."""
        change()
        found = []
        query = stream().writeStream.foreachBatch(lambda df, _: found.extend((r.path, r.change) for r in df.collect())).option("checkpointLocation", marks).trigger(processingTime="200 milliseconds").start()
        try:
            n = 0
            while n < 100 and (query.lastProgress is None or len(query.recentProgress) < 3):
                query.awaitTermination(0.3)
                n += 1
        finally:
            query.stop()
        seen.append(sorted(found))

    run(lambda: None)
    run(lambda: ((root / "a" / "one.md").unlink(), (root / "top.md").write_text("longer than before"), (root / "new").mkdir(), (root / "new" / "five.md").write_text("5")))
    run(lambda: (os.rename(root / "c", root / "d")))
    assert seen[0] == [(p, "created") for p in sorted(["top.md", "a/one.md", "a/b/two.md", "c/three.md", "_x/four.md"])]
    assert seen[1] == [("a/one.md", "deleted"), ("new/five.md", "created"), ("top.md", "changed")]
    assert seen[2] == [("c/three.md", "deleted"), ("d/three.md", "created")]
