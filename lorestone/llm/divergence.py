"""Source divergence audit: how far the sources of a language are from each other in the words they use.

Sorted streams are scanned for runs. In each map task the terms of a few MB of documents at a time are sorted by language,
term, source and document; a run of one term and source gives its document frequency and its count, so a task passes on
rows for runs and not for documents. The partial runs are dealt out by language, term and source, sorted again and
merged by the same scan. Terms in enough documents are kept. A last scan, sorted by language, term and source, turns each run of
a term into shares of its sources, and gives partial distances of pairs of sources and the terms that a source has more
of than its language. The sources of a language come before its terms in the same sorted stream, so nothing is
broadcast; a stretch of terms is handled at a time, as large as its matrix of terms by sources may be.

All arithmetic is in whole numbers: a share is one more than the floor of 10^9 (count + 5) / (N + 5 V), taken in three
steps of long division, so it is exact up to sums of 9 * 10^15.

Defined results: nulls in text, language and source are empty; every row is a document, repeated ones too; a group
without terms, or in a language that keeps none, has pairs of distance 0 and no terms; a language of one source has no pairs; an
empty table gives an empty audit. Of equal values the item of lesser UTF-8 bytes comes first. Other columns
than text, language and source are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorestone.llm import wordvec as wv
from lorestone.llm.common import materialize

#: Documents of its language that a term must be in, and terms listed for a group.
LEAST_DOCUMENTS, MOST_TERMS = 30, 50
#: Bytes of terms in lower-cased text: letters and all that is not ASCII.
LETTERS = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])
#: What is added to every count, and the share of everything.
PRIOR, SCALE = 5, 1000
#: Cells of a matrix of terms by sources, and of one of sources by sources, that a task holds.
CELLS = 1 << 19
#: Bytes of text whose terms a task sorts at a time, runs that it holds before it passes them on, rows of an Arrow batch.
SLICE_BYTES, HELD, BATCH_ROWS = 1 << 22, 600_000, 50_000
KEYS, SUMS = ["lang", "term", "source"], ["documents", "n"]
RUNS = "lang string, term string, source string, documents long, n long"
FOUND = "lang string, source string, part string, item string, value long"


def _sorted_terms(batch: pa.RecordBatch) -> pa.Table:
    """The runs of language, term and source in some documents' terms, sorted by these and by document."""
    data, offsets = wv.buffers(batch.column("text"))
    data = wv.LOWER[data]
    words = wv.split(data, offsets, LETTERS)
    ends = np.concatenate([[0], np.cumsum(words.end - words.start)]).astype(np.int64)
    coded = pa.LargeStringArray.from_buffers(len(words.start), pa.py_buffer(ends), pa.py_buffer(data[LETTERS[data]])).dictionary_encode()
    groups = [batch.column(c).dictionary_encode() for c in ("lang", "source")]
    lang, source = (g.indices.to_numpy() for g in groups)
    order = np.lexsort((source, lang))  # documents by language and source
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    row = place[np.repeat(np.arange(batch.num_rows), np.diff(words.first))]
    lang, source = lang[order].astype(np.int64), source[order]
    terms, rows = max(1, len(coded.dictionary)), max(1, batch.num_rows)
    key, n = np.unique((lang[row] * terms + coded.indices.to_numpy()) * rows + row, return_counts=True)
    key, row = np.divmod(key, rows)  # here a document's run ends
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (source[row[1:]] != source[row[:-1]])
    at = np.flatnonzero(first)
    sums = [np.diff(np.append(at, len(key))), np.add.reduceat(n, at) if len(at) else n]
    named = [groups[0].dictionary.take(pa.array(lang[row[at]])), coded.dictionary.take(pa.array(key[at] % terms)).cast(pa.string()), groups[1].dictionary.take(pa.array(source[row[at]]))]
    return pa.table([*named, *(pa.array(x, pa.int64()) for x in sums)], names=KEYS + SUMS)


def _merged(tables: list[pa.Table]) -> pa.Table:
    whole = pa.concat_tables(tables).group_by(KEYS, use_threads=False).aggregate([(c, "sum") for c in SUMS])
    return whole.rename_columns([c.removesuffix("_sum") for c in whole.column_names]).select(KEYS + SUMS)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a task's documents, merged as long as no more than HELD of them are held."""
    held: list[pa.Table] = []
    for batch in wv.slices(batches, most=SLICE_BYTES):
        held.append(_sorted_terms(batch))
        if sum(map(len, held)) > HELD:
            held = [_merged(held)]
            if len(held[0]) > HELD // 2:
                yield from held.pop().combine_chunks().to_batches(BATCH_ROWS)
    if held:
        yield from _merged(held).combine_chunks().to_batches(BATCH_ROWS)


def _starts(columns: list[pa.Array]) -> np.ndarray:
    """Where a row differs from the one before it; the first does."""
    out = np.ones(len(columns[0]), bool)
    for k, c in enumerate(columns):
        same = pc.fill_null(pc.equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
        both = np.asarray(pc.and_(pc.is_null(c[1:]), pc.is_null(c[:-1])))
        out[1:] = (~(same | both)) if k == 0 else out[1:] | ~(same | both)
    return np.flatnonzero(out)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of each run of language, term and source in a sorted stream; a run may go over many batches."""
    names = KEYS + SUMS
    last: pa.RecordBatch | None = None  # the sums of the run that is still open
    for batch in batches:
        if not batch.num_rows:
            continue
        at = _starts([batch.column(c) for c in names[:3]])
        runs = batch.select(names).take(pa.array(at))
        sums = [np.add.reduceat(batch.column(c).to_numpy(), at) for c in names[3:]]
        if last is not None:
            if all(last.column(c)[0] == runs.column(c)[0] for c in names[:3]):
                for s, c in zip(sums, names[3:], strict=True):
                    s[0] += last.column(c)[0].as_py()
            else:
                yield last
        out = pa.RecordBatch.from_arrays([*(runs.column(c) for c in names[:3]), *map(pa.array, sums)], names)
        yield out.slice(0, out.num_rows - 1)
        last = out.slice(out.num_rows - 1)
    if last is not None:
        yield last


def term_runs(docs: DataFrame) -> DataFrame:
    """``(lang, term, source, documents, n)`` of ``docs(text, lang, source)``, written to the shared folder."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    here = docs.select(empty("text"), empty("lang"), empty("source")).mapInArrow(_terms, RUNS)
    return materialize(here.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(_scan, RUNS))


def shares(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """One more than the floor of 10^9 * counts / whole."""
    out, rest = np.zeros(np.broadcast_shapes(counts.shape, whole.shape), np.int64), counts
    for _ in range(3):
        more, rest = np.divmod(rest * SCALE if _ else counts * SCALE, whole)
        out = out * SCALE + more
    return out + 1


class _Language:
    """The sources of a language in a part of its terms, and what has been found of them."""

    def __init__(self, key: tuple) -> None:
        self.key, self.sources, self.totals, self.kept, self.held = key, [], [], 0, []
        self.names: pa.Array | None = None

    def add(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        head = rows.filter(pc.is_null(rows.column("term")))
        if head.num_rows:
            self.sources.append(head.column("source"))
            self.totals.append(head.column("n").to_numpy())
            self.kept = head.column("kept")[0].as_py()
        if head.num_rows < rows.num_rows:
            self._begin()
            self.held.append(rows.slice(head.num_rows).select(["term", "source", "n"]))
            if sum(map(len, self.held)) > CELLS:
                yield from self._work(False)

    def _begin(self) -> None:
        if self.names is None:
            self.names = pa.concat_arrays(self.sources)
            self.total = np.concatenate(self.totals)
            self.whole = self.total + PRIOR * self.kept
            self.everything = np.array([self.total.sum() + PRIOR * self.kept])
            n = len(self.names)
            self.apart = np.zeros((n, n), np.int64) if n * n <= CELLS else None

    def _work(self, done: bool) -> Iterator[pa.RecordBatch]:
        """Take the held runs, but for the last one if it may go on."""
        if not self.held:
            return
        rows = pa.Table.from_batches(self.held).combine_chunks().to_batches()[0]
        at = np.append(_starts([rows.column("term")]), rows.num_rows)
        runs = len(at) - 1 if done else len(at) - 2
        step = max(1, CELLS // len(self.names))
        for a in range(0, runs, step):
            b = min(runs, a + step)
            yield from self._matrix(rows.slice(at[a], at[b] - at[a]), at[a:b] - at[a])
        self.held = [rows.slice(at[runs])] if not done else []

    def _matrix(self, rows: pa.RecordBatch, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        place = np.searchsorted(at, np.arange(rows.num_rows), "right") - 1
        source = pc.index_in(rows.column("source"), value_set=self.names).to_numpy()
        counts = np.zeros((len(at), len(self.names)), np.int64)
        np.add.at(counts, (place, source), rows.column("n").to_numpy())
        p = shares(counts + PRIOR, self.whole)
        q = shares(counts.sum(1, keepdims=True) + PRIOR, self.everything)
        t, s = np.nonzero((counts > 0) & (p > q))
        yield self._rows("term", s, rows.column("term").take(pa.array(at[t])), (p - q)[t, s])
        for s in range(len(self.names)):
            far = np.abs(p - p[:, s : s + 1]).sum(0)
            if self.apart is not None:
                self.apart[s] += far
            else:
                yield self._pairs(s, far)

    def _pairs(self, s: int, far: np.ndarray) -> pa.RecordBatch:
        others = np.flatnonzero(np.arange(len(far)) != s)
        return self._rows("pair", np.full(len(others), s), self.names.take(pa.array(others)), far[others])

    def _rows(self, part: str, source: np.ndarray, item: pa.Array, value: np.ndarray) -> pa.RecordBatch:
        same = lambda v: pa.array([v] * len(value), pa.string())
        return pa.RecordBatch.from_arrays([same(self.key[1]), self.names.take(pa.array(source)), same(part), item, pa.array(value)], ["lang", "source", "part", "item", "value"])

    def close(self) -> Iterator[pa.RecordBatch]:
        self._begin()
        yield from self._work(True)
        none = np.zeros(len(self.names), np.int64)
        for s in range(len(self.names)):  # every pair is said at least once, of whatever distance
            yield self._pairs(s, self.apart[s] if self.apart is not None else none)


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    language = None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.append(_starts([batch.column("deal"), batch.column("lang")]), batch.num_rows)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            key = (batch.column("deal")[a].as_py(), batch.column("lang")[a].as_py())
            if language is None or language.key != key:
                if language is not None:
                    yield from language.close()
                language = _Language(key)
            yield from language.add(batch.slice(a, b - a))
    if language is not None:
        yield from language.close()


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """``(lang, source, part, item, value)``: partial distances of pairs, and all terms that a source has more of; written."""
    runs = term_runs(docs)
    kept = runs.groupBy("lang", "term").agg(F.sum("documents").alias("d")).filter(F.col("d") >= least).select("lang", "term")
    runs = materialize(runs.join(kept, ["lang", "term"]).select("lang", "term", "source", "n"))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    groups = docs.select(empty("lang"), empty("source")).distinct()
    sums = runs.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    sizes = runs.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("kept"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    deals = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heads = groups.join(sums, ["lang", "source"], "left").join(sizes, "lang", "left").select(F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal"), "lang", F.lit(None).cast("string").alias("term"), "source", zero("n"), zero("kept"))
    rows = runs.select(F.pmod(F.xxhash64("lang", "term"), F.lit(deals)).cast("int").alias("deal"), "lang", "term", "source", "n", F.lit(0).cast("long").alias("kept"))
    dealt = heads.unionByName(rows).repartition(deals, "deal").sortWithinPartitions("deal", "lang", "term", "source")
    return materialize(dealt.mapInArrow(_audit, FOUND))


def divergence_report(docs: DataFrame, least: int = LEAST_DOCUMENTS, most: int = MOST_TERMS) -> DataFrame:
    """Each source's distances to the others of its language, ranked, and the terms that set it apart most."""
    found = audit(docs, least)
    place = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).alias("rank")
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = found.filter("part = 'term'").select("*", place).filter(F.col("rank") <= most)
    return pairs.select("*", place).unionByName(ranked)


OP13_SQL = r"""
with d as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents),
occ as (select r, lang, source, unnest(w) as term from d),
per as (select lang, source, term, count(*) as c, count(distinct r) as df from occ group by all),
kept as (select lang, term, sum(c) as c from per group by all having sum(df) >= 30),
v as (select lang, count(*) as v from kept group by all),
groups as (select distinct lang, source from d),
full_counts as (
  select g.lang, g.source, k.term, coalesce(p.c, 0)::hugeint as c, k.c::hugeint as all_c
  from groups g join kept k using (lang) left join per p on p.lang = g.lang and p.source = g.source and p.term = k.term),
totals as (select lang, source, sum(c)::hugeint as n from full_counts group by all),
alls as (select lang, sum(c)::hugeint as n from kept group by all),
share as (
  select f.lang, f.source, f.term, f.c, 1 + (1000000000::hugeint * (f.c + 5)) // (t.n + 5 * v.v) as p, 1 + (1000000000::hugeint * (f.all_c + 5)) // (a.n + 5 * v.v) as q
  from full_counts f join totals t using (lang, source) join v using (lang) join alls a using (lang)),
pairs as (
  select a.lang, a.source, b.source as item, coalesce(sum(abs(x.p - y.p)), 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join share x on x.lang = a.lang and x.source = a.source left join share y on y.lang = b.lang and y.source = b.source and y.term = x.term
  group by all),
terms as (select lang, source, term as item, (p - q)::bigint as value from share where c > 0 and p > q),
ranked as (
  select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from pairs
  union all
  select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item)::int from terms)
select * from ranked where part = 'pair' or rank <= 50
"""
