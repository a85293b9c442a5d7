"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

Every item's words are one path of the automaton. A document's words are streamed through it and
the length of the longest match is tracked at every word; where it reaches the window, the window's
words are hit. An item with fewer words than the window is a window as a whole. Stretches whose
word pairs never follow each other in any item cannot hold a match of two words, so the automaton
only walks the others; a bitmap of fixed size tells them apart.

Benchmarks are taken in blocks of ``BLOCK_WORDS`` words on average, so the automaton sent to the
executors is bounded whatever the benchmark's size; each block is one pass over the documents. Hits are judged
for all blocks together.

Defined results: null or empty texts have no words and no hits; items without words match nothing;
an item with a null id marks hits but is not listed; repeated ids are one item; an empty benchmark
leaves every document clean. Further columns pass through ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorestone.llm import wordvec as wv
from lorestone.llm.common import materialize, unused

WINDOW = 10
BLOCK_WORDS = 250_000
BITMAP = 24
#: A document of which a larger share of words is hit goes; from any other the hit spans go.
MOST_COVERAGE = 0.5
_SPACE_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Automaton:
    """Suffix automaton of several word sequences; state 0 is the start."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window, self.length, self.link, self.next = window, [0], [-1], [{}]
        self.items: dict[int, set[str]] = {}  # by state of a whole window
        self.short: dict[int, dict[int, set[str]]] = {}  # by state: length of the item to item ids
        self.pairs = np.zeros(1 << BITMAP, bool)
        self.least = window

    def _state(self, length: int, link: int, moves: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(moves)
        return len(self.length) - 1

    def _split(self, p: int, w: int) -> int:
        """The state reached from p by w, split off if it also stands for longer sequences."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[int]) -> None:
        last = 0
        for w in words:
            if w in self.next[last]:
                last = self._split(last, w)
                continue
            new, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, w)
            last = new

    def name(self, words: list[int], item: str | None) -> None:
        """Note the item at the states of its windows, once all sequences are in."""
        self.least = min(self.least, len(words))
        hashed = np.array(words, np.uint64)
        self.pairs[_pair(hashed[:-1], hashed[1:]) if self.least > 1 else np.zeros(0, int)] = True
        for at, (state, _) in enumerate(self.walk(words)):
            if at + 1 >= self.window:
                self.items.setdefault(self._at(state, self.window), set()).update([item] if item is not None else [])
            elif at + 1 == len(words):
                self.short.setdefault(self._at(state, len(words)), {}).setdefault(len(words), set()).update([item] if item is not None else [])

    def _at(self, state: int, length: int) -> int:
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def walk(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """State and length of the longest match that ends at each word."""
        state = length = 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                length += 1
            yield state, length

    def windows(self, state: int, length: int) -> Iterator[tuple[int, set[str]]]:
        """Lengths and items of the windows that end here."""
        if length >= self.window:
            yield self.window, self.items[self._at(state, self.window)]
        while state > 0 and self.short:
            for n, items in self.short.get(state, {}).items():
                if n <= length:
                    yield n, items
            state = self.link[state]


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (wv.mix64(a * np.uint64(3) + b) >> np.uint64(64 - BITMAP)).astype(np.int64)


def build(items: list[tuple[str | None, str]], window: int = WINDOW) -> Automaton:
    found, column = Automaton(window), pa.array([t for _, t in items], pa.string())
    data, offsets = wv.buffers(column)
    data = wv.LOWER[data]
    words = wv.split(data, offsets, wv.ALNUM)
    hashed = wv.hashes(data, words).tolist()
    sequences = [(hashed[words.first[i] : words.first[i + 1]], item) for i, (item, _) in enumerate(items)]
    for sequence, _ in sequences:
        found.add(sequence)
    for sequence, item in sequences:
        if sequence:
            found.name(sequence, item)
    return found


def _stretches(hashed: np.ndarray, first: np.ndarray, automaton: Automaton) -> Iterator[tuple[int, int]]:
    """Word ranges, each in one row, outside of which no window can match."""
    if automaton.least == 1:  # single words are windows
        yield from ((a, b) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True) if b > a)
        return
    follows = automaton.pairs[_pair(hashed[:-1], hashed[1:])] if len(hashed) > 1 else np.zeros(0, bool)
    edge = first[1:-1]
    follows[edge[(edge > 0) & (edge < len(hashed))] - 1] = False
    step = np.diff(np.concatenate([[0], follows.view(np.int8), [0]]))
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long = end - begin >= automaton.least - 1
    yield from zip(begin[long].tolist(), (end[long] + 1).tolist(), strict=True)


def _marks(data: np.ndarray, offsets: np.ndarray, automaton: Automaton) -> tuple[wv.Words, np.ndarray, dict[int, set[str]]]:
    """The words, which of them are hit, and the items by row."""
    data = wv.LOWER[data]
    words = wv.split(data, offsets, wv.ALNUM)
    hashed = wv.hashes(data, words)
    hit = np.zeros(len(hashed), bool)
    items: dict[int, set[str]] = {}
    for a, b in _stretches(hashed, words.first, automaton):
        row = int(np.searchsorted(words.first, a, "right")) - 1
        for at, (state, length) in enumerate(automaton.walk(hashed[a:b].tolist()), a + 1):
            for n, ids in automaton.windows(state, length):
                hit[at - n : at] = True
                items.setdefault(row, set()).update(ids)
    return words, hit, items


def _scan(batches: Iterator[pa.RecordBatch], automaton: Broadcast, keep_all: bool) -> Iterator[pa.RecordBatch]:
    for batch in wv.slices(batches):
        words, hit, items = _marks(*wv.buffers(batch.column("text")), automaton.value)
        which = [np.flatnonzero(hit[a:b]).tolist() for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        out = pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row_key"), pa.array(np.diff(words.first), pa.int64()), pa.array(which, pa.list_(pa.int32())), pa.array([sorted(items.get(i, ())) for i in range(len(which))], pa.list_(pa.string()))],
            ["doc_id", "row_key", "n_words", "hits", "items"],
        )
        yield out if keep_all else out.filter(pa.array([bool(w) for w in which]))


def _blocks(benchmark: DataFrame, window: int) -> Iterator[Automaton]:
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text")).filter(F.col("text").isNotNull())
    total = items.agg(F.sum(F.regexp_count(F.lower("text"), F.lit(_SPACE_CLASS)))).first()[0] or 0
    n = max(1, -(-total // BLOCK_WORDS))
    for k in range(n):
        yield build([tuple(r) for r in items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()], window)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, row_key, n_words, hits, items)`` of every row: the hit words' places, the items' ids."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce("text", F.lit(""))))
    keyed = docs.select("doc_id", "text", key.alias("row_key"))
    schema = f"doc_id {kind}, row_key string, n_words long, hits array<int>, items array<string>"
    passes = [keyed.mapInArrow(partial(_scan, automaton=spark.sparkContext.broadcast(a), keep_all=k == 0), schema) for k, a in enumerate(_blocks(benchmark, window))]
    if len(passes) == 1:
        return passes[0]
    more = passes[1]
    for p in passes[2:]:
        more = more.union(p)
    # rows of equal id and text have equal hits, so one of them stands for all
    more = more.groupBy("row_key").agg(F.collect_set("hits").alias("more_hits"), F.collect_set("items").alias("more_items"))
    both = lambda a, b: F.array_distinct(F.concat(F.col(a), F.coalesce(F.flatten(b), F.array().cast(passes[0].schema[a].dataType))))
    return passes[0].join(more, "row_key", "left").select("doc_id", "row_key", "n_words", both("hits", "more_hits").alias("hits"), both("items", "more_items").alias("items"))


def scan_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = scan(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def _without(text: bytes, starts: np.ndarray, ends: np.ndarray, marked: np.ndarray) -> bytes:
    """The text without its runs of marked words."""
    step = np.diff(np.concatenate([[0], marked.view(np.int8), [0]]))
    pieces, at = [], 0
    for p, q in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1, strict=True):
        pieces.append(text[at : starts[p]])
        at = ends[q]
    return b"".join([*pieces, text[at:]])


def _replaced(batch: pa.RecordBatch, texts: dict[int, str]) -> pa.RecordBatch:
    """The batch with other texts in some rows."""
    if not texts:
        return batch
    column = batch.column("text")
    values = [texts.get(i, v) for i, v in enumerate(column.to_pylist())]
    batch = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(values, column.type))
    if (at := batch.schema.get_field_index("n_chars")) >= 0:
        sizes = [len(texts[i]) if i in texts else v for i, v in enumerate(batch.column(at).to_pylist())]
        batch = batch.set_column(at, "n_chars", pa.array(sizes, batch.column(at).type))
    return batch


def _cut(batches: Iterator[pa.RecordBatch], automaton: Broadcast, most_coverage: float) -> Iterator[pa.RecordBatch]:
    for batch in wv.slices(batches):
        data, offsets = wv.buffers(batch.column("text"))
        words, hit, _ = _marks(data, offsets, automaton.value)
        keep, texts = np.ones(batch.num_rows, bool), {}
        for i in np.unique(np.searchsorted(words.first, np.flatnonzero(hit), "right") - 1).tolist():
            a, b = words.first[i], words.first[i + 1]
            if hit[a:b].mean() > most_coverage:
                keep[i] = False
                continue
            text = data[offsets[i] : offsets[i + 1]].tobytes()
            starts, ends, marked = words.start[a:b] - offsets[i], words.end[a:b] - offsets[i], hit[a:b]
            while marked.any():  # what a removal brings together is looked at again
                text = _without(text, starts, ends, marked)
                again, marked, _ = _marks(np.frombuffer(text, np.uint8), np.array([0, len(text)]), automaton.value)
                starts, ends = again.start, again.end
            texts[i] = text.decode()
        batch = _replaced(batch, texts)
        yield batch if keep.all() else batch.filter(pa.array(keep))


def _cut_at(batches: Iterator[pa.RecordBatch], names: list[str], hits: str, most_coverage: float) -> Iterator[pa.RecordBatch]:
    """The rows without the words at their ``hits``, once."""
    for batch in wv.slices(batches):
        data, offsets = wv.buffers(batch.column("text"))
        words = wv.split(wv.LOWER[data], offsets, wv.ALNUM)
        keep, texts = np.ones(batch.num_rows, bool), {}
        for i, places in enumerate(batch.column(hits)):
            a, b = words.first[i], words.first[i + 1]
            marked = np.zeros(b - a, bool)
            marked[places.values.to_numpy()] = True
            if marked.mean() > most_coverage:
                keep[i] = False
                continue
            texts[i] = _without(data[offsets[i] : offsets[i + 1]].tobytes(), words.start[a:b] - offsets[i], words.end[a:b] - offsets[i], marked).decode()
        yield _replaced(batch.select(names), texts).filter(pa.array(keep))


def _hits(keyed: DataFrame, blocks: list[Broadcast], key: str, hits: str) -> DataFrame:
    """``(key, hits)`` of the rows that some block hits: the places of all blocks."""
    rows = keyed.select(F.lit(0).alias("doc_id"), F.col(key).alias("row_key"), "text")
    schema = "doc_id int, row_key string, n_words long, hits array<int>, items array<string>"
    found = [rows.mapInArrow(partial(_scan, automaton=a, keep_all=False), schema).select("row_key", "hits") for a in blocks]
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    return every.groupBy(F.col("row_key").alias(key)).agg(F.array_distinct(F.flatten(F.collect_set("hits"))).alias(hits))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_coverage: float = MOST_COVERAGE) -> DataFrame:
    """``docs`` without the spans that match; documents that mostly match go.

    One pass for a benchmark of one block. With more, the hits of all blocks are brought together before
    they are judged and cut, and what was cut is looked at again by all blocks until none hits it.
    """
    blocks = [docs.sparkSession.sparkContext.broadcast(a) for a in _blocks(benchmark, window)]
    if len(blocks) == 1:
        return docs.mapInArrow(partial(_cut, automaton=blocks[0], most_coverage=most_coverage), docs.schema)
    mark, places = unused(docs.columns, "__key"), unused(docs.columns, "__hits")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    key = F.sha2(F.concat(F.length(name).cast("string"), F.lit(":"), name, F.coalesce("text", F.lit(""))), 256)
    left, done = docs, None
    while True:
        # rows of equal id and text have equal hits, so they may share a key
        keyed = materialize(left.withColumn(mark, key))
        hits = materialize(_hits(keyed, blocks, mark, places))
        clear = keyed.join(hits, mark, "left_anti").select(*docs.columns)
        done = clear if done is None else done.union(clear)
        if hits.isEmpty():
            return done
        left = keyed.join(hits, mark).drop(mark).mapInArrow(partial(_cut_at, names=docs.columns, hits=places, most_coverage=most_coverage), docs.schema)
        most_coverage = 1.0  # documents are judged as they came


OP8_SQL = r"""
with recursive item_words as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
wins as (
  select distinct item_id, least(len(w), 10) as n, unnest(list_transform(range(1, greatest(len(w) - 10, 0) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) as g
  from item_words where len(w) > 0),
doc_words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
grams as (
  select d.doc_id, l.n, p.pos, array_to_string(d.w[p.pos:p.pos + l.n - 1], ' ') as g
  from doc_words d, (select distinct n from wins) l, lateral (select unnest(range(1, len(d.w) - l.n + 2)) as pos) p),
found as (select g.doc_id, g.n, g.pos, w.item_id from grams g join wins w on w.n = g.n and w.g = g.g),
hits as (select doc_id, count(distinct f.pos + t.k) as n_hit from (select distinct doc_id, n, pos from found) f, lateral (select unnest(range(0, f.n)) as k) t group by 1),
items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from found group by 1)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(h.n_hit, 0)::bigint as n_hit, coalesce(i.n_items, 0)::bigint as n_items,
  sha256(coalesce(i.ids, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated
from doc_words d left join hits h using (doc_id) left join items i using (doc_id)
"""
