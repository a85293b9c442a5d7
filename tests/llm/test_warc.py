"""Revisit resolution in WARC archives against a plain walk, with other archives' records, hot payloads and damage."""

from __future__ import annotations

import gzip
import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lorestone.llm import common, warc

SCHEMA = "page_id long, url string, html string"


def plainly(rows, least=100):
    by, out = defaultdict(list), []
    for page, _, html in rows:
        by[html or ""].append(page)
    for html, pages in by.items():
        raw = html.encode()
        order = sorted(pages, key=lambda p: (p is None, p or 0))
        for k, page in enumerate(order):
            again = k > 0 and len(raw) >= least
            out.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", order[0] if again else None))
    return sorted(map(repr, out))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    html = [f"<p>page {k} " + "déjà vu " * rng.choice([1, 20, 300]) for k in range(12)] + ["", None, "x" * 99, "y" * 100, "é" * 50, "big " * 1_000_000, "a\r\n\r\nWARC/1.1\r\n" * 20]
    out = [(i, f"http://h{i % 3}/ü?a=%20\n{i}" if i % 5 else None, rng.choice(html)) for i in range(120)]
    return out + [out[7], out[7], (None, None, html[0]), (None, "http://n", "only here " * 20), (None, "http://n", "only here " * 20)] + [(500 + i, "http://hot", "hot page " * 30) for i in range(60)]


def said(df):
    return sorted(repr(tuple(r)) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


@pytest.mark.parametrize("few", [20_000, 0])
def test_pages(spark, rows, few, monkeypatch):
    monkeypatch.setattr(warc, "bounded", lambda df: common.bounded(df, few))
    monkeypatch.setattr(warc, "HOT", 10)
    assert said(warc.warc_report(spark.createDataFrame(rows, SCHEMA).repartition(5))) == plainly(rows)


def test_other_types_names_and_empty_tables(spark, rows):
    pages = spark.createDataFrame([("b c\n", None, "z" * 200), ("a%0A", None, "z" * 200), (" b", "u", "z" * 200)], "page_id string, url string, html string").withColumns({c: F.lit("own") for c in ("archive", "at", "original", "sharing", "part", "hot")})
    assert [(r.page_id, r.record_type, r.refers_to) for r in warc.warc_report(pages).orderBy("page_id").collect()] == [(" b", "response", None), ("a%0A", "revisit", " b"), ("b c\n", "revisit", " b")]
    empty = warc.warc_report(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and dict(empty.dtypes) == {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"}


def foreign(kind, name, payload=b"", **fields):
    http = b"" if kind == "warcinfo" else b"HTTP/1.1 200 OK\r\nContent-Length: 300\r\n\r\n"
    block = http + payload
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:{name}>", "WARC-Date": "2020-01-01T00:00:00Z", "Content-Type": "application/warc-fields" if kind == "warcinfo" else "application/http; msgtype=response"} | {k.replace("_", "-"): v for k, v in fields.items()}
    return gzip.compress("WARC/1.0\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n")


def test_archives_of_others(spark, tmp_path):
    body = b"b" * 300
    digest = "sha256:" + hashlib.sha256(body).hexdigest()
    old, new = tmp_path / "old", tmp_path / "new"
    old.mkdir()
    (old / "b+1.warc.gz").write_bytes(foreign("warcinfo", "info", b"software: x") + foreign("revisit", "early", WARC_Payload_Digest=digest, WARC_Refers_To="<urn:gone>", WARC_Target_URI="http://e"))
    (old / "a.warc.gz").write_bytes(foreign("response", "one", body, WARC_Target_URI="http://one") + foreign("response", "two", body) + foreign("revisit", "lost", WARC_Payload_Digest="sha256:00", WARC_Refers_To="<urn:gone>"))
    uris = [warc.qualified(spark, str(p)) for p in (old, new)]
    records = warc.read_records(warc.list_archives(spark, uris[0]), uris[0])
    assert sorted(r.record_id for r in records.collect()) == ["<urn:early>", "<urn:info>", "<urn:lost>", "<urn:one>", "<urn:two>"]
    index = warc.deduplicate(warc.resolve(records), *uris, date="2024-05-06T07:08:09Z")
    back = {r.record_id: r for r in warc.revisited(warc.read_records(index, uris[1])).collect()}
    one, two, early, lost = (back[warc._fresh(f"<urn:{n}>")] for n in ("one", "two", "early", "lost"))
    assert (one.record_type, one.payload_bytes, one.date) == ("response", 300, "2024-05-06T07:08:09Z")
    assert {(r.record_type, r.refers_to_record, r.payload_bytes, "sha256:" + r.payload_digest) for r in (two, early)} == {("revisit", one.record_id, 300, digest)}
    assert (lost.record_type, lost.refers_to_record, lost.payload_digest) == ("revisit", "<urn:gone>", "00") and back["<urn:info>"].record_type == "warcinfo"
    text = b"".join(gzip.decompress(p.read_bytes()) for p in new.glob("*.warc.gz"))
    assert text.count(body) == 1 and text.count(b"WARC-Refers-To-Target-URI: http://one") == 2 and text.count(warc.PROFILE.encode()) == 2


def test_damage_is_an_error(spark, tmp_path):
    whole = foreign("response", "one", b"b" * 300, WARC_Payload_Digest="sha256:" + "0" * 64)
    uri = warc.qualified(spark, str(tmp_path))
    for content, message in ((whole, "stored wrongly"), (whole[:-20], "within a record")):
        (tmp_path / "x.warc.gz").write_bytes(content)
        with pytest.raises(Exception, match=message):
            warc.read_records(spark.createDataFrame([("x.warc.gz",)], "archive string"), uri)
