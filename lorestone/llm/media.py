"""Media columns: content-addressed payloads in tar shards.

Texts become payloads, and payloads 8-bit grey PNG images of a fixed width. Each task packs its
images into one tar shard in the shared folder, equal payloads once; rows carry the image's digest,
the shard, and the offset and length of the image in it. Metadata columns come from range reads of
the first bytes of each image, whole images are read only to get payloads back.

A shard's name is new for every attempt of a task and only the rows of attempts that succeeded are
kept, so lost executors and repeated tasks leave at most shards that no row names.

Defined results: a null text is empty; an empty text is one line of blanks; equal texts have equal
images and metadata; repeated rows share an image; an empty table writes no shards. Other columns
than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type

from lorestone.llm import wordvec as wv
from lorestone.llm.common import materialize, scratch_dir

WIDTH = 192
LEVEL = 1
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature, and the header chunk with its length, type, 13 bytes and checksum.
HEADER_BYTES = 8 + 25
INDEX = "doc_ids array<{kind}>, digest binary, shard string, at long, length int, n_bytes long"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes, width: int = WIDTH) -> bytes:
    """A PNG file of 8-bit grey samples, rows unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    raw = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw, LEVEL)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample, from the first HEADER_BYTES of an image."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG image")
    width, height, bits = struct.unpack(">IIB", head[16:25])
    return width, height, bits


def decode(image: bytes) -> bytes:
    width, height, _ = read_header(image)
    at, parts = HEADER_BYTES, []
    while at < len(image):
        (n,) = struct.unpack(">I", image[at : at + 4])
        if image[at + 4 : at + 8] == b"IDAT":
            parts.append(image[at + 8 : at + 8 + n])
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def payload_of(text: bytes, width: int = WIDTH) -> bytes:
    return text + b" " * (-len(text) % width if text else width)


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme that Spark itself would take for it, so that tasks open the same store."""
    if "://" in folder:
        return folder
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    full = path.makeQualified(store.getUri(), store.getWorkingDirectory()).toString()
    return full if "://" in full else full.replace(":/", ":///", 1)


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _pack(batches: Iterator[pa.RecordBatch], folder: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Write this task's images as one shard; a row for each distinct image, with the ids it stands for."""
    store, root = _filesystem(folder)
    name = f"{uuid.uuid4().hex}.tar"
    entries: dict[bytes, list] = {}
    out = None
    try:
        at = 0
        for batch in wv.slices(batches):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary())
            for doc_id, text in zip(ids, texts, strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                digest = hashlib.sha256(raw).digest()
                if digest not in entries:
                    if out is None:
                        store.create_dir(root)
                        out = store.open_output_stream(f"{root}/{name}")
                    image = encode(payload_of(raw))
                    member = tarfile.TarInfo(hashlib.sha256(image).hexdigest() + ".png")
                    member.size = len(image)
                    head = member.tobuf(tarfile.USTAR_FORMAT)
                    pad = -len(image) % 512
                    out.write(head + image + b"\0" * pad)
                    entries[digest] = [[], hashlib.sha256(image).digest(), name, at + len(head), len(image), len(raw)]
                    at += len(head) + len(image) + pad
                entries[digest][0].append(doc_id)
        if out is not None:
            out.write(b"\0" * 1024)
    finally:
        if out is not None:
            out.close()
    rows = list(entries.values())
    for a in range(0, len(rows), 5000):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 5000], strict=True), schema.types, strict=True)], schema=schema)


def pack(docs: DataFrame, folder: str) -> DataFrame:
    """The index of the shards written to ``folder``, itself written to the shared folder. Ids may be of any type."""
    kind = docs.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)
    schema = pa.schema([("doc_ids", pa.list_(arrow)), ("digest", pa.binary()), ("shard", pa.string()), ("at", pa.int64()), ("length", pa.int32()), ("n_bytes", pa.int64())])
    return materialize(docs.select("doc_id", "text").mapInArrow(partial(_pack, folder=folder, schema=schema), INDEX.format(kind=kind.simpleString())))


def _ranges(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[tuple[pa.RecordBatch, Iterator]]:
    """Each batch with a reader of ``(at, length)`` ranges of its shards, which stay open in turn."""
    store, root = _filesystem(folder)
    name, file = "", None
    try:
        for batch in batches:

            def read(i: int, length: int, batch: pa.RecordBatch = batch) -> bytes:
                nonlocal name, file
                if batch.column("shard")[i].as_py() != name:
                    if file is not None:
                        file.close()
                    name = batch.column("shard")[i].as_py()
                    file = store.open_input_file(f"{root}/{name}")
                return file.read_at(length, batch.column("at")[i].as_py())

            yield batch, read
    finally:
        if file is not None:
            file.close()


def _headers(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    for batch, read in _ranges(batches, folder):
        found = [read_header(read(i, HEADER_BYTES)) for i in range(batch.num_rows)]
        for k, c in enumerate(("width", "height", "bits")):
            batch = batch.append_column(c, pa.array([x[k] for x in found], pa.int32()))
        yield batch


def fill_metadata(index: DataFrame, folder: str) -> DataFrame:
    """The index with ``width``, ``height`` and ``bits``, from HEADER_BYTES of each image."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index.schema) + ", width int, height int, bits int"
    return index.mapInArrow(partial(_headers, folder=folder), schema)


def _payloads(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    for batch, read in _ranges(batches, folder):
        rows = []
        for i, (digest, length) in enumerate(zip(batch.column("digest").to_pylist(), batch.column("length").to_pylist(), strict=True)):
            image = read(i, length)
            if hashlib.sha256(image).digest() != digest:
                raise OSError(f"image {digest.hex()} was stored wrongly")
            payload = decode(image)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
        for k, (c, kind) in enumerate((("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()))):
            batch = batch.append_column(c, pa.array([x[k] for x in rows], kind))
        yield batch


def read_payloads(index: DataFrame, folder: str) -> DataFrame:
    """The index with size, digest and last bytes' checksum of each payload, read back and checked."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index.schema) + ", payload_bytes long, payload_sha256 string, tail_crc32 long"
    return index.mapInArrow(partial(_payloads, folder=folder), schema)


def media_report(docs: DataFrame, folder: str | None = None) -> DataFrame:
    folder = qualified(docs.sparkSession, folder or scratch_dir(docs.sparkSession))
    index = pack(docs, folder)
    full = read_payloads(fill_metadata(index, folder), folder)
    return full.selectExpr(
        "explode(doc_ids) as doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "cast(length as bigint) as media_bytes", "lower(hex(digest)) as media_sha256",
        "concat('png:', width, 'x', height, 'x', bits) as feature",
    )
