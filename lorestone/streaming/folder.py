"""A folder as a data source in Python: a table of its files, and a stream of what is created, changed and deleted, which
Spark's own file source does not say.

``spark.dataSource.register(FolderSource)``, then ``spark.read.format("folder").option("root", ...)`` or ``spark.readStream``. A stream's offset
is a number of listings: each micro-batch lists the folders of the first level in tasks, holds every list against the last
one and keeps it under ``state``, a folder that driver and executors share. A list that is there already is read, not made
again, so a batch that is run again gives the same rows. ``path`` and ``mtime`` filters reach the table's reader. Symbolic links to folders
are not followed."""

from __future__ import annotations

import json
import os
import posixpath
from collections.abc import Iterator, Sequence

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, StringStartsWith
from pyspark.sql.types import StructType

FILES = "path string, mtime double, size_bytes bigint"
CHANGES = "path string, change string, mtime double, size_bytes bigint"


class _Folder(InputPartition):
    """A folder of the first level, or the files beside them (the empty name), between two listings."""

    def __init__(self, name: str, start: int = 0, end: int = 0) -> None:
        self.name, self.start, self.end = name, start, end


def _under(store: fs.FileSystem, base: str, name: str, deep: bool) -> Iterator[tuple[str, float, int]]:
    """Files in a folder, and below it."""
    todo = [name]
    while todo:
        folder = todo.pop()
        for x in store.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base, allow_not_found=True)):
            path = x.path[len(base) :].strip("/")
            if x.type == fs.FileType.File:
                yield path, x.mtime_ns / 1e9, x.size
            elif deep and x.type == fs.FileType.Directory and not (isinstance(store, fs.LocalFileSystem) and os.path.islink(x.path)):
                todo.append(path)


def _first_level(root: str) -> list[str]:
    store, base = fs.FileSystem.from_uri(root)
    found = store.get_file_info(fs.FileSelector(base))
    return sorted(posixpath.basename(x.path) for x in found if x.type == fs.FileType.Directory and not (isinstance(store, fs.LocalFileSystem) and os.path.islink(x.path)))


class _Reader(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root, self.equal, self.starts, self.after = root, None, "", None

    def partitions(self) -> Sequence[InputPartition]:
        names = ["", *_first_level(self.root)]
        if self.equal is not None:
            return [_Folder(self.equal.partition("/")[0] if "/" in self.equal else "")]
        return [_Folder(n) for n in names if not self.starts or f"{n}/".startswith(self.starts) or self.starts.startswith(f"{n}/") or not n and "/" not in self.starts]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        store, base = fs.FileSystem.from_uri(self.root)
        for row in _under(store, base, partition.name, bool(partition.name)):
            if self.after is None or row[1] >= self.after:
                yield row


class _Pushed(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Filters on a path or its beginning leave out folders; those on time leave out files."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("path",):
                self.equal = f.value
            elif isinstance(f, StringStartsWith) and f.attribute == ("path",):
                self.starts = max(self.starts, f.value, key=len)
            elif isinstance(f, GreaterThan | GreaterThanOrEqual) and f.attribute == ("mtime",):
                self.after = max(self.after or f.value, f.value)
            yield f  # Spark applies it again, so it need not be exact here


class _Stream(DataSourceStreamReader):
    def __init__(self, root: str, state: str) -> None:
        self.root, self.state, self.number = root, state, None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"listing": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        """The next listing; after a restart, the one after those that are kept."""
        if self.number is None:
            store, base = fs.FileSystem.from_uri(self.state)
            found = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
            self.number = max((int(n) for x in found if (n := posixpath.basename(x.path)).isdigit()), default=0)
        self.number += 1
        return {"listing": self.number}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        """Folders of the first level, and those that the last listing had."""
        store, base = fs.FileSystem.from_uri(self.state)
        kept = f"{base}/{end['listing']}/folders"
        if store.get_file_info(kept).type == fs.FileType.NotFound:
            names = _first_level(self.root)
            self._write(store, kept, names)
        names = set(self._load(store, kept)) | set(self._load(store, f"{base}/{start['listing']}/folders"))
        return [_Folder(n, start["listing"], end["listing"]) for n in ["", *sorted(names)]]

    @staticmethod
    def _write(store: fs.FileSystem, path: str, rows: list) -> None:
        store.create_dir(posixpath.dirname(path))
        part = f"{path}.{os.getpid()}.{os.urandom(4).hex()}"
        with store.open_output_stream(part) as out:
            out.write(json.dumps(rows).encode())
        store.move(part, path)

    @staticmethod
    def _load(store: fs.FileSystem, path: str) -> list:
        if store.get_file_info(path).type == fs.FileType.NotFound:
            return []
        with store.open_input_stream(path) as file:
            return json.loads(file.readall())

    def read(self, partition: _Folder) -> Iterator[tuple]:
        store, base = fs.FileSystem.from_uri(self.state)
        place = "list-" + partition.name.encode().hex()
        kept = f"{base}/{partition.end}/{place}"
        if store.get_file_info(kept).type == fs.FileType.NotFound:
            files, root = fs.FileSystem.from_uri(self.root)
            self._write(store, kept, sorted(_under(files, root, partition.name, bool(partition.name))))
        new = {p: (t, n) for p, t, n in self._load(store, kept)}
        old = {p: (t, n) for p, t, n in self._load(store, f"{base}/{partition.start}/{place}")}
        for p, (t, n) in new.items():
            if old.get(p) != (t, n):
                yield p, "changed" if p in old else "created", t, n
        for p, (t, n) in old.items():
            if p not in new:
                yield p, "deleted", t, n

    def commit(self, end: dict) -> None:
        """Listings before the last one are needed no more."""
        store, base = fs.FileSystem.from_uri(self.state)
        for x in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            name = posixpath.basename(x.path)
            if name.isdigit() and int(name) < end["listing"]:
                store.delete_dir(x.path)


class FolderSource(DataSource):
    """Options: ``root``, a folder with its scheme; for a stream also ``state``; ``pushdown``, true where the session has
    spark.sql.python.filterPushdown.enabled, without which Spark refuses readers that take filters."""

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return CHANGES if "state" in self.options else FILES

    def reader(self, schema: StructType) -> DataSourceReader:
        kind = _Pushed if self.options.get("pushdown") == "true" else _Reader
        return kind(self.options["root"].rstrip("/"))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self.options["root"].rstrip("/"), self.options["state"].rstrip("/"))
