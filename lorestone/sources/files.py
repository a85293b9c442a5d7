"""Sources: scanned folders with their rules, rule files, and peers' announcements."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyarrow import fs
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorestone.operators.incremental import Rule, merge_rules
from lorestone.sources import ignore
from lorestone.sources.rules import Trie
from lorestone.sources.scratch import written

FILES = "path string, content binary, mtime double, size_bytes bigint, content_hash string"


def relative(path: Column, root: str) -> Column:
    """Paths as Spark's readers name them, without scheme and root."""
    plain = F.regexp_replace(F.url_decode(F.regexp_replace(path, r"\+", "%2B")), r"^[a-z0-9]+:/*", "/")
    return F.regexp_replace(plain, "^" + "".join("\\" + c if not c.isalnum() and c not in "/_" else c for c in "/" + root.split(":")[-1].strip("/")) + "/?", "")


def qualified(spark: SparkSession, root: str) -> str:
    """The folder with the scheme that Spark would take for it, so that tasks open the same store."""
    if "://" in root:
        return root.rstrip("/")
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return re.sub(r":/+", "://" if "file" not in str(store.getUri()) else ":///", path.makeQualified(store.getUri(), store.getWorkingDirectory()).toString(), count=1)


LISTED = "path string, mtime double, size_bytes bigint, is_dir boolean, rule string, states array<int>, ignored boolean"


def listing(spark: SparkSession, root: str, ignored: bool = True, rules: Sequence[Rule] | None = None, tracked: DataFrame | None = None, opened: Accumulator | None = None) -> DataFrame:
    """``(path, mtime, size_bytes)`` of the files below ``root``, names with a leading underscore or dot among them, which
    Spark's own readers pass over. A job lists a level of folders, its tasks a folder each. Symbolic links to folders are not followed.

    What the ignore rules of the folders above exclude is left out, unless ``ignored`` is false or ``tracked(path)`` names it; with ``rules``
    there is ``rule``, only files that they take are there, and folders where no rule is alive are not opened. ``opened`` counts folders."""
    uri, trie = qualified(spark, root), Trie(rules) if rules is not None else None

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for folder, states, within in zip(batch["path"], batch["states"], batch["ignored"], strict=True):
                if opened is not None:
                    opened.add(1)
                rows = []
                for x in store.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base)):
                    path, is_dir = x.path[len(base) :].strip("/"), x.type == fs.FileType.Directory
                    if x.type not in (fs.FileType.File, fs.FileType.Directory) or is_dir and isinstance(store, fs.LocalFileSystem) and os.path.islink(x.path):
                        continue
                    below = trie.enter(states, path) if trie and is_dir else []
                    rule = trie.match(states, path) if trie and not is_dir else None
                    if trie is None or below or rule is not None or path.rpartition("/")[2] == ignore.NAME:
                        rows.append((path, x.mtime_ns / 1e9, x.size, is_dir, rule, below, within))
                yield pd.DataFrame(rows, columns=["path", "mtime", "size_bytes", "is_dir", "rule", "states", "ignored"]).astype({"size_bytes": "Int64"})

    start = spark.createDataFrame([("", trie.root() if trie else [], False)], "path string, states array<int>, ignored boolean")
    level, levels, known = start, [], None
    while True:
        found = written(level.mapInPandas(names, LISTED))
        if ignored:
            known = _more_rules(found, uri, known)
            found = _kept(found, known, tracked)
        levels.append(found.filter("not is_dir").select("path", "mtime", "size_bytes", *(["rule"] if trie else [])))
        level = found.filter("is_dir").select("path", "states", "ignored")
        n = level.count()
        if not n:
            out = reduce(DataFrame.union, levels)
            return out.filter("rule is not null") if trie else out
        level = level.repartition(min(n, spark.sparkContext.defaultParallelism * 4))


def _more_rules(found: DataFrame, uri: str, known: DataFrame | None) -> DataFrame:
    """The rules of the levels before and of this one's ignore files, which tasks read."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for path in batch["path"]:
                with store.open_input_file(f"{base}/{path}") as file:
                    rows = ignore.rules_of(path.rpartition("/")[0], file.readall().decode("utf-8", "replace"))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in ignore.RULES.split(", ")])

    own = found.filter(~F.col("is_dir") & (F.substring_index("path", "/", -1) == ignore.NAME)).select("path")
    if own.isEmpty():
        return known if known is not None else found.sparkSession.createDataFrame([], ignore.RULES)
    fresh = own.mapInPandas(lines, ignore.RULES)
    return written(fresh if known is None else known.union(fresh))


def _kept(found: DataFrame, rules: DataFrame, tracked: DataFrame | None) -> DataFrame:
    """Entries that are not ignored, by themselves or with their folder, and of the others tracked files and the folders above them."""
    columns = [c.split()[0] for c in LISTED.split(", ")]
    decided = ignore.decided(found.withColumnRenamed("ignored", "within"), rules)
    decided = decided.withColumn("ignored", F.col("within") | F.col("ignored") | F.col("is_dir") & (F.substring_index("path", "/", -1) == ".git"))
    if tracked is None:
        return written(decided.filter("not ignored").select(*columns))
    above = tracked.select(F.explode(F.expr("transform(sequence(1, size(split(path, '/'))), k -> array_join(slice(split(path, '/'), 1, k), '/'))")).alias("path")).distinct()
    held = decided.join(above.withColumn("held", F.lit(True)), "path", "left")
    return written(held.filter("not ignored or held").select(*columns))


def with_content(files: DataFrame, root: str) -> DataFrame:
    """Listed files with ``content`` and ``content_hash``, read in tasks; what has gone meanwhile is left out."""
    uri = qualified(files.sparkSession, root)
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in files.schema)}, content binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for at in range(len(batch)):  # a file at a time, as one may be large
                try:
                    with store.open_input_file(f"{base}/{batch['path'].iloc[at]}") as file:
                        yield batch.iloc[at : at + 1].assign(content=[file.readall()])
                except FileNotFoundError:
                    continue

    return files.mapInPandas(run, schema).withColumn("content_hash", F.sha2("content", 256))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """Every file below ``root`` with its content and the content's hash."""
    return with_content(listing(spark, root), root).select("path", "content", "mtime", "size_bytes", "content_hash")


def discover(spark: SparkSession, root: str, rules: Sequence[Rule], tracked: DataFrame | None = None, ignored: bool = True) -> DataFrame:
    """Files with their rule; of those, where ``tracked(path)`` is given, the tracked ones. Only these are read."""
    files = listing(spark, root, ignored, rules, tracked)
    return with_content(files if tracked is None else files.join(tracked.select("path"), "path", "left_semi"), root)


def read_tracked(spark: SparkSession, names: str) -> DataFrame:
    """``(path)`` of the tracked files, from a text file with a name a line."""
    return spark.read.text(names).select(F.trim("value").alias("path")).filter("path <> ''").distinct()


def read_rules(text: str) -> list[Rule]:
    """Rules from JSON: a list, or an object with the list under ``rules``."""
    loaded = json.loads(text)
    listed = loaded if isinstance(loaded, list) else loaded.get("rules", [])
    return [Rule(r["ruleName"], r["match"]["glob"], r.get("exclude", False), tuple(r.get("labels", ())), (r.get("chunking") or {}).get("split_level")) for r in listed]


#: Where a folder's own settings may be, the first that is there counts; and rules if there are none anywhere.
SETTINGS = (".lorestone.json", "lorestone.json", ".lorestone/config.json")
DEFAULT_RULES = (Rule("default", "**/*.md"),)


def _loaded(text: str | None) -> dict | None:
    """An object of settings; a plain list, as older files have, is its rules."""
    if text is None:
        return None
    found = json.loads(text)
    return {"rules": found} if isinstance(found, list) else found


def settings(root: str, general: str | None = None, names: Sequence[str] = SETTINGS) -> dict:
    """``rules``, ``name``, ``graph`` and what else is set for the folder ``root``: its own settings go over those of the folder ``general``,
    rule by rule and field by field; with neither, all Markdown files are taken. Both folders are named with their scheme."""

    def read(folder: str | None, name: str) -> dict | None:
        if folder is None:
            return None
        store, base = fs.FileSystem.from_uri(folder)
        if store.get_file_info(f"{base}/{name}").type != fs.FileType.File:
            return None
        with store.open_input_stream(f"{base}/{name}") as file:
            return _loaded(file.readall().decode())

    shared = read(general, "config.json")
    own = next((found for name in names if (found := read(root, name)) is not None), None)
    if shared is None and own is None:
        return {"rules": list(DEFAULT_RULES)}
    fields = {k: v for part in (shared, own) for k, v in (part or {}).items() if k != "rules" and v is not None}
    rules = [read_rules(json.dumps(part)) if part is not None else [] for part in (shared, own)]
    return fields | {"rules": merge_rules(*rules)}


PEERS = "name string, pid bigint, socket string, project_root string, started_at double"


def read_peers(spark: SparkSession, folder: str, own: str | None = None) -> DataFrame:
    """Peers' announcements, one JSON file each; files that can't be read are left out."""
    peers = spark.read.schema(PEERS).option("multiLine", True).option("mode", "DROPMALFORMED").json(folder).filter("name is not null")
    return peers if own is None else peers.filter(F.col("name") != own)


def peer_status(peers: DataFrame, live_pids: DataFrame) -> DataFrame:
    alive = live_pids.select("pid", F.lit(True).alias("alive"))
    return peers.join(alive, "pid", "left").withColumn("status", F.when(F.col("alive"), "alive").otherwise("unreachable")).drop("alive")
