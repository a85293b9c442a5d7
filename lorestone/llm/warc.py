"""WARC archives whose repeated payloads are revisits.

``archive`` writes pages as response records, one gzip member a record and one archive a task. ``read_records``
walks archives, its own or others', a task an archive, and returns their headers. ``resolve`` shuffles headers, never payloads,
by payload digest: of the responses that share a payload the one with the least page is the original, and
every other record of that payload, revisits that were there before among them, is joined to it. ``deduplicate`` then
reads the records at their places in the old archives and writes new ones: originals with their payloads, revisits
with HTTP headers alone, all with fresh WARC headers. ``revisited`` brings records that were read back and what they refer to
together.

An archive's name is new for every attempt of a task, and only archives that a successful attempt's row names
count, so lost executors leave at most files that no row names. A record's fresh id is made of its old one, so a
revisit knows its original's id before that is written.

Hot payloads: the original is a minimum with partial sums in each task; the join back sends originals that have
revisits to all tasks if a count shows that they are few, and deals the records of a payload that very many share over parts.

Defined results: a null payload is empty; payloads under the least size are always responses; a null page comes after all
others and has no header; records of equal payload and page (repeated rows) are settled by archive and place; the rest
of one page's repeated records are revisits of it; control characters of an address are percent-encoded, a null
address has no header; a revisit without an original stays as it is; records of other types are copied;
an empty table writes no archives. Other columns than page_id, url and html are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from functools import partial
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorestone.llm import wordvec as wv
from lorestone.llm.common import bounded, materialize, scratch_dir
from lorestone.llm.media import qualified

#: Bytes from which on equal payloads are revisits.
LEAST_BYTES = 100
LEVEL, CHUNK = 1, 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records of one original from which on they are dealt over so many parts.
HOT, PARTS = 10_000, 64
INDEX = "archive string, at long, length long"
RECORDS = f"{INDEX}, record_type string, record_id string, page_id string, url string, date string, payload_bytes long, payload_digest string, refers_to_record string"


def _member(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record as one gzip member."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    head = f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode()
    return z.compress(head + block + b"\r\n\r\n") + z.flush()


def _named(*parts: object) -> str:
    """A record's id that these parts settle."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr(parts).encode()).digest()[:16], version=4)}>"


def _fresh(record_id: str | None) -> str | None:
    return None if record_id is None else _named("fresh", record_id)


def _one_line(value: str | None) -> str | None:
    return None if value is None else "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


class _Archive:
    """The archive that a task writes, opened with its first record."""

    def __init__(self, folder: str) -> None:
        (self.store, self.root), self.name, self.out, self.at = fs.FileSystem.from_uri(folder), f"{uuid.uuid4().hex}.warc.gz", None, 0

    def add(self, member: bytes) -> tuple[str, int, int]:
        if self.out is None:
            self.store.create_dir(self.root)
            self.out = self.store.open_output_stream(f"{self.root}/{self.name}", compression=None)
        self.out.write(member)
        self.at += len(member)
        return self.name, self.at - len(member), len(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema.types, strict=True)], schema=schema)


_INDEX = pa.schema([("archive", pa.string()), ("at", pa.int64()), ("length", pa.int64())])
_RECORDS = pa.schema([*_INDEX, *((c, pa.string()) for c in ("record_type", "record_id", "page_id", "url", "date")), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to_record", pa.string())])


def _store(batches: Iterator[pa.RecordBatch], folder: str, date: str) -> Iterator[pa.RecordBatch]:
    archive = _Archive(folder)
    try:
        for batch in wv.slices(batches, "html"):
            rows = []
            for page, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                payload = (html or "").encode()
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                fields = [("WARC-Type", "response"), ("WARC-Record-ID", _named(archive.name, archive.at)), ("WARC-Date", date), ("WARC-Target-URI", _one_line(url)), ("WARC-Page-ID", None if page is None else quote(page))]
                fields += [("WARC-Payload-Digest", f"sha256:{hashlib.sha256(payload).hexdigest()}"), ("Content-Type", "application/http;msgtype=response")]
                rows.append(archive.add(_member(fields, http + payload)))
            yield _rows(rows, _INDEX)
    finally:
        archive.close()


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def archive(pages: DataFrame, folder: str, date: str | None = None) -> DataFrame:
    """``(archive, at, length)`` of the records of ``pages(page_id, url, html)`` in new archives in ``folder``, written."""
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return materialize(rows.mapInArrow(partial(_store, folder=folder, date=date or now()), INDEX))


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """``(archive)``: names of the archives in a folder that others wrote."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return files.select(F.url_decode(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\+", "%2B")).alias("archive"))


def _walk(file: object) -> Iterator[tuple[int, int, bytes]]:
    """Place, length and content of each gzip member of an open file."""
    z, at, begin, parts, data = zlib.decompressobj(31), 0, 0, [], b""
    while True:
        if not data:
            data = file.read(CHUNK)
            if not data:
                break
        parts.append(z.decompress(data))
        left = len(z.unused_data) if z.eof else 0
        at += len(data) - left
        data = data[len(data) - left :] if left else b""
        if z.eof:
            yield begin, at - begin, b"".join(parts)
            z, begin, parts = zlib.decompressobj(31), at, []
    if at > begin:
        raise OSError("an archive ends within a record")


def parse(record: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """The WARC header's fields, by names in lower case, the HTTP header with its empty line, and the payload."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if not fields.get("content-type", "").startswith("application/http"):
        return fields, b"", block
    end = block.find(b"\r\n\r\n")
    return (fields, block[: end + 4], block[end + 4 :]) if end >= 0 else (fields, block, b"")


def _described(record: bytes) -> tuple:
    """What RECORDS says of a record beside its place; a response's payload must have the digest that its header names."""
    fields, http, payload = parse(record)
    kind, (label, _, digest) = fields["warc-type"], fields.get("warc-payload-digest", "").partition(":")
    size, page = None, unquote(fields["warc-page-id"]) if "warc-page-id" in fields else None
    if kind == "response":
        size, found = len(payload), hashlib.sha256(payload).hexdigest()
        if label == "sha256" and digest != found:
            raise OSError(f"record {fields.get('warc-record-id')} was stored wrongly")
        digest = found
    elif kind == "revisit":
        said = [v for k, _, v in (line.partition(b":") for line in http.split(b"\r\n")) if k.strip().lower() == b"content-length"]
        size = int(said[0]) if said and said[0].strip().isdigit() else None
    return kind, fields.get("warc-record-id"), page, fields.get("warc-target-uri"), fields.get("warc-date"), size, digest or None, fields.get("warc-refers-to")


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    store, root = fs.FileSystem.from_uri(folder)
    for batch in batches:
        for name in batch.column("archive").to_pylist():
            rows = []
            with store.open_input_stream(f"{root}/{name}", compression=None) as file:
                for at, length, record in _walk(file):
                    rows.append((name, at, length, *_described(record)))
                    if len(rows) >= 4096:
                        yield _rows(rows, _RECORDS)
                        rows = []
            yield _rows(rows, _RECORDS)


def read_records(archives: DataFrame, folder: str) -> DataFrame:
    """RECORDS of all that the ``archives(archive)`` in ``folder`` hold, walked from end to end and written."""
    names = materialize(archives.select("archive").distinct())
    # as many tasks as archives: their names are small, what they stand for is not
    return materialize(names.repartition(max(1, names.count())).mapInArrow(partial(_read, folder=folder), RECORDS))


def _to_originals(many: DataFrame, originals: DataFrame, key: str) -> DataFrame:
    """``many`` left-joined to ``originals``, one row a key, whose ``sharing`` says how many rows share it."""
    small = bounded(originals)
    if small is not originals:
        return many.join(small, key, "left")
    hot = bounded(originals.filter(F.col("sharing") > HOT).select(key, F.lit(True).alias("hot")))
    parts = F.when(F.col("sharing") > HOT, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    part = F.when(F.col("hot"), F.pmod(F.xxhash64("archive", "at"), F.lit(PARTS)).cast("int")).otherwise(0)
    return many.join(hot, key, "left").withColumn("part", part).drop("hot").join(originals.withColumn("part", F.explode(parts)), [key, "part"], "left").drop("part")


def resolve(records: DataFrame, kind: str = "string", least: int = LEAST_BYTES) -> DataFrame:
    """RECORDS with ``original``: the record, page, address and date that a record revisits, null where it is a response.

    Pages count as numbers or whatever type ``kind`` is."""
    page = F.col("page_id").cast(kind)
    able = F.col("payload_digest").isNotNull() & F.coalesce(F.col("payload_bytes") >= least, F.lit(True)) & F.col("record_type").isin("response", "revisit")
    place = F.struct(page.isNull().alias("last"), page.alias("page"), "archive", "at", F.struct("record_id", "page_id", "url", "date").alias("original"))
    first = records.filter(able).groupBy("payload_digest").agg(F.min(F.when(F.col("record_type") == "response", place)).alias("first"), F.count("*").alias("sharing"))
    first = materialize(first.filter("sharing > 1 and first is not null"))
    here = (F.col("archive") == F.col("first.archive")) & (F.col("at") == F.col("first.at"))
    return _to_originals(records, first, "payload_digest").select(*records.columns, F.when(able & ~here, F.col("first.original")).alias("original"))


def _rewrite(batches: Iterator[pa.RecordBatch], old: str, new: str, date: str) -> Iterator[pa.RecordBatch]:
    """Copy records at their places in the old archives, which come in order, into a new archive."""
    (store, root), archive, name, file = fs.FileSystem.from_uri(old), _Archive(new), None, None
    try:
        for batch in batches:
            rows = []
            for r in batch.select(["archive", "at", "length", "original"]).to_pylist():
                if r["archive"] != name:
                    if file is not None:
                        file.close()
                    name, file = r["archive"], store.open_input_file(f"{root}/{r['archive']}")
                member = file.read_at(r["length"], r["at"])
                rows.append(archive.add(_renewed(member, r["original"], date)))
            yield _rows(rows, _INDEX)
    finally:
        archive.close()
        if file is not None:
            file.close()


def _renewed(member: bytes, original: dict | None, date: str) -> bytes:
    fields, http, payload = parse(zlib.decompress(member, 31))
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        return member
    head = [("WARC-Type", "revisit" if original else kind), ("WARC-Record-ID", _fresh(fields.get("warc-record-id"))), ("WARC-Date", date), ("WARC-Target-URI", fields.get("warc-target-uri")), ("WARC-Page-ID", fields.get("warc-page-id"))]
    digest = fields.get("warc-payload-digest") or (f"sha256:{hashlib.sha256(payload).hexdigest()}" if kind == "response" else None)
    head += [("WARC-Payload-Digest", digest), ("Content-Type", "application/http;msgtype=response")]
    if original:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _fresh(original["record_id"])), ("WARC-Refers-To-Target-URI", original["url"]), ("WARC-Refers-To-Date", date)]
    elif kind == "revisit":
        head += [(k, fields.get(k.lower())) for k in ("WARC-Profile", "WARC-Refers-To", "WARC-Refers-To-Target-URI", "WARC-Refers-To-Date")]
    return _member(head, http if original or kind == "revisit" else http + payload)


def deduplicate(resolved: DataFrame, old: str, new: str, date: str | None = None) -> DataFrame:
    """``(archive, at, length)`` of the records, written anew into archives in ``new``."""
    resolved = resolved.select("archive", "at", "length", "original")
    rows = resolved.repartition(max(1, resolved.select("archive").distinct().count()), "archive").sortWithinPartitions("archive", "at")
    return materialize(rows.mapInArrow(partial(_rewrite, old=old, new=new, date=date or now()), INDEX))


def revisited(records: DataFrame) -> DataFrame:
    """RECORDS with ``refers_to``: the page that a revisit's record refers to; its size and digest are then those of
    the payload there."""
    revisits = records.filter("record_type = 'revisit'").groupBy(F.col("refers_to_record").alias("record_id")).agg(F.count("*").alias("sharing"))
    there = records.filter("record_type = 'response'").select("record_id", F.col("page_id").alias("there"), F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("digest"))
    there = materialize(there.join(revisits, "record_id").withColumnRenamed("record_id", "refers_to_record"))
    own = lambda theirs, mine: F.when(F.col("record_type") == "revisit", F.coalesce(theirs, mine)).otherwise(F.col(mine)).alias(mine)
    kept = [c for c in records.columns if c not in ("payload_bytes", "payload_digest")]
    return _to_originals(records, there, "refers_to_record").select(*kept, own("n", "payload_bytes"), own("digest", "payload_digest"), F.col("there").alias("refers_to"))


def warc_report(pages: DataFrame, folder: str | None = None, least: int = LEAST_BYTES) -> DataFrame:
    """Per page: what the deduplicated archives, read back, hold of it."""
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType.simpleString()
    raw, clean = (qualified(spark, f"{folder or scratch_dir(spark)}/{name}") for name in ("raw", "clean"))
    crawled = read_records(archive(pages.select("page_id", "url", "html"), raw), raw)
    resolved = materialize(resolve(crawled, kind, least))
    found = revisited(read_records(deduplicate(resolved, raw, clean), clean))
    as_page: list[Column] = [F.col(c).cast(kind).alias(c) for c in ("page_id", "refers_to")]
    return found.select(as_page[0], "payload_bytes", "payload_digest", "record_type", as_page[1])


OP11_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, octet_length(payload)::bigint as payload_bytes, sha256(payload) as payload_digest from p),
r as (select *, row_number() over (partition by payload_digest order by page_id nulls last) as k, first_value(page_id) over (partition by payload_digest order by page_id nulls last) as first from d)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and k > 1 then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and k > 1 then first end as refers_to
from r
"""
