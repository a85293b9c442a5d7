"""Secret scans over an incremental blob ledger.

Every version of every file is addressed by the SHA-256 of its text. The ledger has one row for
each scan of a blob: which rules, by version, were applied and what they found. An update scans
only blobs that lack a current rule, each blob once and with just the rules it lacks; findings are
then joined back to all paths that hold the blob. Changing a rule's version scans its pairs anew; what
an older version, or a rule that is gone, has found stays in the ledger but is no finding any more.

Defined results: a null text is the empty blob; blobs without findings give empty lists; repeated
rows share one blob, which is scanned once; an empty table adds nothing; a column ``found`` of the
documents is replaced. Only the id and the text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorestone.llm import wordvec as wv
from lorestone.llm.common import BROADCAST_ROWS, bounded, materialize, scratch_dir

#: Kind, version, pattern, group whose length counts, its least length. Spans are whole matches.
RULES = (
    ("assign", 1, re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 6),
    ("access", 1, re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", 1, re.compile(r"[0-9a-f]{24,}"), 0, 24),
    ("forge", 1, re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"), 0, 40),
    ("pem", 1, re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END (?:[A-Z]+ )*PRIVATE KEY-----)?"), 0, 0),
)
BASE = ("assign", "access", "hex")
#: Lower-case text without one of these, or a long run of hexadecimal digits, has no match of any rule.
HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key", b"akia", b"-----begin", b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_")
_HEX = np.array([48 <= b <= 57 or 97 <= b <= 102 for b in range(256)])
LEDGER = "blob binary, rules array<string>, found array<struct<rule:string,kind:string,start:int,end:int>>"
#: Spans of all findings that are sent to every task at most; beyond, they are joined, and a blob of more than
#: HOT paths by PARTS parts.
BROADCAST_SPANS, HOT, PARTS = 300_000, 10_000, 64


def current_rules(rules: tuple = RULES) -> list[str]:
    return [f"{kind}@{version}" for kind, version, *_ in rules]


def spans(text: str, wanted: set[str], rules: tuple = RULES) -> list[tuple[str, int, int]]:
    """Spans of the rules wanted, by start and then in the order of ``rules``; ends are exclusive."""
    found = [(m.start(), k, kind, m.end()) for k, (kind, version, pattern, group, least) in enumerate(rules) if f"{kind}@{version}" in wanted for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def _hinted(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows in which some rule may match."""
    low = wv.LOWER[data]
    raw, places = low.tobytes(), []
    for hint in HINTS:
        at = raw.find(hint)
        while at >= 0:
            places.append(at)
            at = raw.find(hint, at + 1)  # a hit that goes over the end of a row may overlap the next row's own
    step = np.diff(np.concatenate([[0], _HEX[low].view(np.int8), [0]]))
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    # a run may go on over the end of a row; then rows are scanned for nothing, never the reverse
    places.extend(p for b, e in zip(begin[end - begin >= 24], end[end - begin >= 24], strict=True) for p in (b, e - 1, *offsets[(offsets > b) & (offsets < e)]))
    hinted = np.zeros(len(offsets) - 1, bool)
    hinted[np.searchsorted(offsets, np.unique(np.array(places, np.int64)), "right") - 1] = True
    return hinted


def _scan(batches: Iterator[pa.RecordBatch], rules_: tuple) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("rule", pa.string()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    named = dict(zip((k for k, *_ in rules_), current_rules(rules_), strict=True))
    # the hints are those of RULES; other patterns are tried on every text
    hints = all(any(rule[2:] == known[2:] for known in RULES) for rule in rules_)
    for batch in wv.slices(batches):
        text, rules = batch.column("text"), batch.column("rules")
        found: list[list] = [[] for _ in range(batch.num_rows)]
        for i in (np.flatnonzero(_hinted(*wv.buffers(text))).tolist() if hints else range(batch.num_rows)):
            found[i] = [{"rule": named[k], "kind": k, "start": s, "end": e} for k, s, e in spans(text[i].as_py() or "", set(rules[i].as_py()), rules_)]
        yield pa.RecordBatch.from_arrays([batch.column("blob"), rules, pa.array(found, kind)], ["blob", "rules", "found"])


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LEDGER)


def update_ledger(docs: DataFrame, path: str, rules: tuple = RULES) -> None:
    """Scan what the ledger at ``path`` lacks, and add it.

    Which blobs are new is settled on digests alone; only their texts are shuffled then, one row a
    blob, by a digest of the row, so copies do not meet in one task.
    """
    spark = docs.sparkSession
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce("text", F.lit(""))))
    keyed = docs.select("text", key.alias("row_key"))
    blobs = docs.select(blob_of(F.col("text")).alias("blob"), key.alias("row_key")).groupBy("blob").agg(F.min("row_key").alias("row_key"))
    seen = read_ledger(spark, path).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("seen"))
    lacks = F.array_except(F.array(*map(F.lit, current_rules(rules))), F.coalesce("seen", F.array().cast("array<string>")))
    wanted = blobs.join(seen, "blob", "left").select("blob", "row_key", lacks.alias("rules")).filter(F.size("rules") > 0)
    texts = keyed.join(wanted.hint("shuffle_hash"), "row_key").select("blob", "rules", "text")
    new = texts.mapInArrow(partial(_scan, rules_=rules), LEDGER)
    # rows that repeat an id and a text were scanned alike: one of their entries stays
    new.dropDuplicates(["blob"]).write.mode("append").parquet(path)


def findings(docs: DataFrame, path: str, rules: tuple = RULES) -> DataFrame:
    """``docs`` with ``found``: the spans of the rules' present versions, by start and rule, from the ledger.

    If a count shows that they are few, they go to all tasks. Otherwise they are joined, and the paths of a blob that
    very many hold are dealt over parts by their ids, so that no task gets them all."""
    ledger = read_ledger(docs.sparkSession, path)
    known = F.array(*[F.lit(kind) for kind, *_ in rules])
    present = F.filter("found", lambda s: s["rule"].isin(*current_rules(rules)))
    hit = ledger.select("blob", present.alias("found")).filter(F.size("found") > 0).groupBy("blob").agg(F.flatten(F.collect_set("found")).alias("found"))
    ordered = F.array_sort(F.transform("found", lambda s: F.struct(s["start"].alias("start"), F.array_position(known, s["kind"]).alias("place"), s["kind"].alias("kind"), s["end"].alias("end"))))
    hit = hit.select(F.col("blob").alias("__blob"), F.filter(F.array_distinct(ordered), lambda s: s["place"] > 0).alias("found"))
    columns = [c for c in docs.columns if c.lower() != "found"]
    out = docs.select(*columns, blob_of(F.col("text")).alias("__blob"))
    none = F.array().cast("array<struct<start:int,place:bigint,kind:string,end:int>>")
    hit = materialize(hit)
    if hit.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS and hit.agg(F.coalesce(F.sum(F.size("found")), F.lit(0))).first()[0] <= BROADCAST_SPANS:
        out = out.join(F.broadcast(hit), "__blob", "left")
    else:
        hot = bounded(materialize(out.groupBy("__blob").count().filter(F.col("count") > HOT).select("__blob", F.lit(True).alias("__hot"))))
        part = F.when(F.col("__hot"), F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")).otherwise(0)
        parts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
        out = out.join(hot, "__blob", "left").withColumn("__part", part)
        hit = hit.join(hot, "__blob", "left").select("__blob", "found", F.explode(parts).alias("__part"))
        out = out.join(hit, ["__blob", "__part"], "left")
    return out.select(*columns, F.coalesce("found", none).alias("found"))


def secrets_report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Counts and digests of the spans of every document, by a ledger at ``path`` or a fresh one."""
    path = path or scratch_dir(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    update_ledger(docs, path)
    found = findings(docs.select("doc_id", "text"), path)
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("found")).alias("spans"))
