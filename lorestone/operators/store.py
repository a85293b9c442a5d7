"""Stored tables of a knowledge base.

``Buckets`` is a table of Parquet files in folders by a hash of its key. A change reads and rewrites the folders it touches,
by Spark's dynamic partition overwrite, and a lookup reads one. A writer names the version that it has read and claims
the next one, so of two writers with one version the later fails, and loses nothing of the other's. ``write`` and ``read``
replace small tables as a whole, in snapshot folders, under the same rule.

Claims and snapshots need a file system that creates a file for one of two writers only, as HDFS and local disks do. A reader
whose files a commit takes away fails and reads again; a lost executor costs its tasks alone.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorestone.model import checked_vector


class Stale(RuntimeError):
    """The table has changed, or is being changed, since the version that a writer has read."""


def _files(spark: SparkSession, *parts: str) -> tuple[JavaObject, JavaObject]:
    path = spark._jvm.org.apache.hadoop.fs.Path("/".join(p.rstrip("/") for p in parts))
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def names_in(spark: SparkSession, *parts: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    files, path = _files(spark, *parts)
    return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []


def _create(spark: SparkSession, path: str, content: str) -> bool:
    """Whether the file is new and ours."""
    files, at = _files(spark, path)
    try:
        out = files.create(at, False)
    except Py4JJavaError as e:
        if not files.exists(at):
            raise e
        return False
    out.write(bytearray(content.encode()))
    out.close()
    return True


@dataclass(frozen=True)
class Buckets:
    """A table under ``root`` with ``schema``, in folders by a hash of the text column ``key``. The number of folders is settled
    by the first write; a folder should hold no more than a task can rewrite."""

    spark: SparkSession
    root: str
    schema: str
    key: str
    wanted: int = 16

    #: Versions whose claims are kept, for a look at what was touched.
    KEPT = 100

    @property
    def number(self) -> int:
        """Of folders."""
        said = [n for n in names_in(self.spark, self.root, "_log") if n.startswith("folders-")]
        return int(said[0].partition("-")[2]) if said else self.wanted

    def _log(self) -> tuple[int, int]:
        """The newest finished version and the newest claimed one."""
        names = names_in(self.spark, self.root, "_log")
        done = max((int(n[:-5]) for n in names if n.endswith(".done")), default=0)
        return done, max((int(n[:-6]) for n in names if n.endswith(".claim")), default=done)

    def version(self) -> int:
        return self._log()[0]

    def place(self, key: Column) -> Column:
        """The folder of a key."""
        return F.pmod(F.xxhash64(F.coalesce(key, F.lit(""))), F.lit(self.number)).cast("int")

    def _all(self) -> DataFrame:
        if not names_in(self.spark, self.root, "data"):
            return self.spark.createDataFrame([], f"{self.schema}, bucket int")
        return self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.root}/data")

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """The table, or what is in some folders alone."""
        rows = self._all()
        return (rows if buckets is None else rows.filter(F.col("bucket").isin(list(buckets)))).drop("bucket")

    def lookup(self, key: str) -> DataFrame:
        """The rows of a key, from its folder alone."""
        return self._all().filter((F.col("bucket") == self.place(F.lit(key))) & (F.col(self.key) == key)).drop("bucket")

    def touched(self, *keys: DataFrame) -> list[int]:
        """The folders of the keys: no more numbers than there are folders."""
        places = [k.select(self.place(F.col(self.key)).alias("b")) for k in keys]
        return sorted(r.b for r in reduce(DataFrame.union, places).distinct().collect())

    def replace(self, rows: DataFrame, version: int, gone: DataFrame | None = None, unique: Sequence[str] | None = None) -> int:
        """Put ``rows`` in the place of all that has their keys, or equals them in the ``unique`` columns, and take out the keys of ``gone``: the version
        that is current then. Nothing is written if there is nothing to do."""
        if self._log() != (version, version):
            raise Stale(f"{self.root} is at {self._log()}, not at {version}")
        keys = list(unique or [self.key])
        buckets = self.touched(rows, *([gone] if gone is not None else []))
        if not buckets:
            return version
        if not version:
            _create(self.spark, f"{self.root}/_log/folders-{self.number}", "")
        claim = f"{self.root}/_log/{version + 1:010d}.claim"
        if not _create(self.spark, claim, json.dumps(buckets)):
            raise Stale(f"{self.root} is being changed")
        before = {b: set(names_in(self.spark, f"{self.root}/data/bucket={b}")) for b in buckets}
        try:
            held = self.read(buckets)
            if gone is not None:
                held = held.join(gone.select(F.col(self.key).alias("__gone")).distinct(), held[self.key].eqNullSafe(F.col("__gone")), "left_anti")
            same = [held[k].eqNullSafe(F.col(f"__{k}")) for k in keys]
            held = held.join(rows.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct(), same, "left_anti")
            new = held.unionByName(rows.select(*held.columns)).withColumn("bucket", self.place(F.col(self.key)))
            spread = new.repartition(min(len(buckets), 4 * self.spark.sparkContext.defaultParallelism), "bucket")
            spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.root}/data")
        except Exception:
            files, path = _files(self.spark, claim)
            if before == {b: set(names_in(self.spark, f"{self.root}/data/bucket={b}")) for b in buckets}:
                files.delete(path, False)  # nothing has changed, so nobody need settle it
            raise
        for b in buckets:  # dynamic overwrite leaves folders that get no rows
            if before[b] & set(names_in(self.spark, f"{self.root}/data/bucket={b}")):
                files, path = _files(self.spark, f"{self.root}/data/bucket={b}")
                files.delete(path, True)
        _create(self.spark, f"{self.root}/_log/{version + 1:010d}.done", "")
        self._forget(version + 1 - self.KEPT)
        return version + 1

    def _forget(self, until: int) -> None:
        files, path = _files(self.spark, self.root, "_log")
        for n in names_in(self.spark, self.root, "_log"):
            if n[:10].isdigit() and int(n[:10]) < until:
                files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path, n), False)

    def changes(self, version: int) -> list[int]:
        """The folders that a version has touched."""
        files, path = _files(self.spark, self.root, "_log", f"{version:010d}.claim")
        text = files.open(path)
        try:
            return json.loads(bytes(text.readAllBytes()).decode())
        finally:
            text.close()

    def settle(self) -> list[int]:
        """After a writer has died: its claim counts as finished. The folders it may have left half changed are given
        back, for their owner to build anew."""
        done, claimed = self._log()
        if claimed == done:
            return []
        _create(self.spark, f"{self.root}/_log/{claimed:010d}.done", "")
        return self.changes(claimed)

    def sync(self, rows: DataFrame, version: int, unique: Sequence[str] | None = None) -> int:
        """Make the table equal to ``rows``: the folders of what differs are rewritten, all others are only read."""
        if not version:
            return self.replace(rows, version, None, unique)
        keys = list(unique or [self.key])
        names = [f.name for f in self._all().drop("bucket").schema]
        plain = lambda df: [F.array_sort(F.map_entries(c)).alias(c) if df.schema[c].dataType.typeName() == "map" else F.col(c) for c in names]
        said = lambda df, mark: df.select(*[F.col(k).alias(f"{mark}{k}") for k in keys], F.sha2(F.to_json(F.struct(*plain(df))), 256).alias(f"{mark}said"), F.lit(True).alias(f"{mark}there"))
        here, there = said(self.read(), "h_"), said(rows, "t_")
        both = here.join(there, [F.col(f"h_{k}").eqNullSafe(F.col(f"t_{k}")) for k in keys], "full")
        differ = both.filter(~F.col("h_said").eqNullSafe(F.col("t_said"))).select(F.coalesce(f"h_{self.key}", f"t_{self.key}").alias(self.key)).distinct()
        other = differ.select(F.col(self.key).alias("__differ"))
        return self.replace(rows.join(other, F.col(self.key).eqNullSafe(F.col("__differ")), "left_semi"), version, differ, unique)


def snapshots(spark: SparkSession, root: str) -> list[str]:
    """Complete snapshots, the newest first. One counts once its job has committed."""
    files, path = _files(spark, root)
    if not files.exists(path):
        return []
    found = [s.getPath() for s in files.listStatus(path) if s.isDirectory() and s.getPath().getName().startswith("v")]
    done = [p for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted((p.toString() for p in done), reverse=True)


def newest(spark: SparkSession, root: str) -> int:
    """The number of the newest snapshot, 0 if there is none."""
    return next((int(p.rpartition("/v")[2]) for p in snapshots(spark, root)), 0)


def read(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The newest snapshot whose first row can be read; none is an empty table of the schema."""
    for path in snapshots(spark, root):
        try:
            table = spark.read.parquet(path)
            table.head(1)
            return table
        except (PySparkException, Py4JJavaError):  # a damaged snapshot; the one before it still counts
            continue
    return spark.createDataFrame([], schema)


def write(table: DataFrame, root: str, version: int, kept: int = 2) -> DataFrame:
    """``table`` as the snapshot after ``version``, the one that the writer has read, read back. All but the newest snapshots go."""
    spark = table.sparkSession
    path = f"{root.rstrip('/')}/v{version + 1:08d}"
    if newest(spark, root) != version or not _create(spark, f"{root.rstrip('/')}/_claims/{version + 1:08d}", ""):
        raise Stale(f"{root} is not at version {version} any more")
    try:
        table.write.mode("overwrite").parquet(path)  # what a dead writer may have left has no _SUCCESS
    except Exception:
        files, claim = _files(spark, root, "_claims", f"{version + 1:08d}")
        files.delete(claim, False)
        raise
    for old in snapshots(spark, root)[kept:]:
        files, gone = _files(spark, old)
        files.delete(gone, True)
    return spark.read.schema(table.schema).parquet(path)


def evolve(table: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Columns that an older table lacks, by their defaults; there, nulls are kept as they are."""
    return table.withColumns({c: v for c, v in defaults.items() if c not in table.columns}) if set(defaults) - set(table.columns) else table


#: Columns that tables of earlier versions lack, and what they hold then.
CHUNK_DEFAULTS = {"kind": "text", "language": "", "artifact_qualname": "", "parent_document_id": ""}


def evolved_chunks(chunks: DataFrame) -> DataFrame:
    chunks = evolve(chunks, {c: F.lit(v) for c, v in CHUNK_DEFAULTS.items()})
    return evolve(chunks, {"section_breadcrumb": F.col("header_breadcrumb")})


def delete(table: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def with_vectors(chunks: DataFrame, dimensions: int) -> DataFrame:
    """The chunks, each of which must have a vector of so many dimensions; it is an error at run time otherwise."""
    vector = F.when(F.col("vector").isNull(), F.raise_error(F.concat(F.lit("no vector for chunk "), F.coalesce("chunk_id", F.lit("?"))))).otherwise(checked_vector(F.col("vector"), dimensions))
    return chunks.withColumn("vector", vector)


def append_chunks(table: DataFrame, chunks: DataFrame, dimensions: int) -> DataFrame:
    """``table`` and the chunks, with vectors as ``with_vectors`` asks for."""
    return table.unionByName(with_vectors(chunks, dimensions).select(*table.columns))


def replace_documents(table: DataFrame, chunks: DataFrame, documents: DataFrame, dimensions: int) -> DataFrame:
    """The chunks of ``documents(file_path)`` replaced by the given ones: deletion and addition are one snapshot."""
    return append_chunks(delete(table, documents, ["file_path"]), chunks, dimensions)


def restored(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Empty texts, which stand for what is missing, as nulls."""
    return table.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in columns})
