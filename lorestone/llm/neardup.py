"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

Two permutations of the 32-bit numbers make the whole signature: coordinate k is the least
``pi(sigma(x) + k)`` over a set's shingles, the second permutation being shifted round by k. Bands
are as many as keep the chance to miss a pair at the threshold under ``MISS``; equal sets are one
class from the start, so copies never meet as pairs.

Links are confirmed on full sets in two steps. First every class is held against its nearest few
of its buckets' outermost members, a number of pairs in proportion to the classes. Then, in buckets
that still hold more than one component, whole chunks of classes are compared as sets inside tasks,
which give back links only. Pairs within a component are left out, as they cannot change it.

Defined results: an empty or null text, or one without words, has no shingles and no links; null
ids are never a component's name, and a component of null ids only has a null name; repeated rows
fall into one class; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorestone.llm import wordvec as wv
from lorestone.llm.common import bounded, materialize, unused
from lorestone.llm.components import components

#: The chance that banding or sketches may lose a pair that is just at the threshold.
MISS, SKETCH_MISS = 1e-6, 1e-9
MOST_COORDINATES = 192
NEAREST = 3
#: Classes, and shingles of them, that a chunk of a bucket has about.
CHUNK_ROWS, CHUNK_SHINGLES = 256, 500_000
#: Rows of a class that is dealt over so many parts when names are joined to rows.
HOT, PARTS = 10_000, 64
_BLOCK = 1 << 15


@dataclass(frozen=True)
class Setup:
    """Sets of ``words``-word shingles are linked if ``100 * intersection >= percent * union``."""

    words: int = 5
    percent: int = 80

    @property
    def bands(self) -> tuple[int, int]:
        """Bands and rows of a band: the most rows that MISS and MOST_COORDINATES allow. A threshold so low that
        not even bands of one row keep to MISS is an error."""
        t, found = self.percent / 100, None
        for rows in range(1, 33):
            n = math.ceil(math.log(MISS) / math.log1p(-(t**rows))) if t < 1 else 1
            if n * rows > MOST_COORDINATES:
                break
            found = (n, rows)
        if not found:
            raise ValueError(f"{self.percent}% takes more than {MOST_COORDINATES} coordinates to miss a pair with a chance of {MISS:g} only")
        return found

    @property
    def differing_bits(self) -> int:
        """Bits in which the sketches of a pair at the threshold differ at most, but for SKETCH_MISS."""
        n, p = math.prod(self.bands), (1 - self.percent / 100) / 2
        tail, d = 1.0, -1
        while tail > SKETCH_MISS:
            d += 1
            tail -= math.comb(n, d) * p**d * (1 - p) ** (n - d)
        return d


def _fold(x: np.ndarray) -> np.ndarray:
    """The first permutation, of shingles folded to 32 bits, times the second one's first factor."""
    x = (x >> np.uint64(32)).astype(np.uint32)
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return (x ^ (x >> np.uint32(16))) * np.uint32(0x9E3779B1)


def signatures(sets: np.ndarray, begin: np.ndarray, coordinates: int) -> np.ndarray:
    """(rows, coordinates) least values; rows without shingles keep the largest number."""
    out = np.full((coordinates, len(begin) - 1), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(begin))
    x = _fold(sets)
    at = 0
    while at < len(full):  # blocks of rows whose shingles fit the cache; a longer row is in pieces
        row = full[at]
        stop = max(at + 1, int(np.searchsorted(begin[full], begin[row] + _BLOCK, "right")) - 1)
        rows = full[at:stop]
        for low in range(begin[row], begin[rows[-1] + 1], _BLOCK * 2):
            high = min(low + _BLOCK * 2, begin[rows[-1] + 1])
            starts = np.maximum(begin[rows], low) - low
            y = x[low:high]
            for k in range(coordinates):
                t = y + np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)
                t ^= t >> np.uint32(15)
                t *= np.uint32(0x2C1B3C6D)
                t ^= t >> np.uint32(13)
                least = np.minimum.reduceat(t, starts) if len(starts) > 1 else t.min(keepdims=True)
                out[k, rows] = np.minimum(out[k, rows], least)
        at = stop
    return out.T


def _sign(batches: Iterator[pa.RecordBatch], setup: Setup) -> Iterator[pa.RecordBatch]:
    bands, rows = setup.bands
    n = bands * rows
    weights = wv.mix64(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
    for batch in wv.slices(batches):
        data, offsets = wv.buffers(batch.column("text"))
        data = wv.LOWER[data]
        words = wv.split(data, offsets)
        sets, begin = wv.shingles(wv.hashes(data, words), words.first, setup.words)
        count = np.diff(begin)
        starts = np.minimum(begin[:-1], max(0, len(sets) - 1))
        total = lambda x: np.where(count > 0, np.add.reduceat(x, starts), 0).astype(np.uint64) if len(sets) else np.zeros(len(count), np.uint64)  # noqa: B023, E731
        keys = [total(wv.mix64(sets + np.uint64(s))) for s in (11, 23)]
        sign = signatures(sets, begin, n)
        band = (sign.reshape(-1, bands, rows).astype(np.uint64) * weights).sum(2, dtype=np.uint64)
        band = wv.mix64(wv.mix64(band) + np.arange(bands, dtype=np.uint64))
        bits = np.packbits(np.pad((wv.mix64(sign.astype(np.uint64)) & np.uint64(1)).astype(np.uint8), ((0, 0), (0, -n % 64))), axis=1)
        sketch = np.ascontiguousarray(bits).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row_key"), pa.array(count.astype(np.int64)), *[pa.array(k.view(np.int64)) for k in keys],
             wv.list_array(band.view(np.int64).ravel(), np.arange(len(count) + 1) * bands), wv.list_array(sketch.ravel(), np.arange(len(count) + 1) * sketch.shape[1])],
            ["doc_id", "row_key", "n", "k1", "k2", "bands", "sketch"],
        )


def _sets(batches: Iterator[pa.RecordBatch], setup: Setup) -> Iterator[pa.RecordBatch]:
    for batch in wv.slices(batches):
        data, offsets = wv.buffers(batch.column("text"))
        data = wv.LOWER[data]
        words = wv.split(data, offsets)
        sets, begin = wv.shingles(wv.hashes(data, words), words.first, setup.words)
        yield pa.RecordBatch.from_arrays([batch.column("cls"), wv.list_array(sets.view(np.int64), begin)], ["cls", "items"])


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of incidence matrices over a few shingles at a time.
    Only shingles that both sides have get a column."""
    a, b = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)
    row = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    where = [np.searchsorted(both, x) for x in (a, b)]
    known = [(w < len(both)) & (both[np.minimum(w, len(both) - 1)] == x) if len(both) else np.zeros(len(x), bool) for w, x in zip(where, (a, b), strict=True)]
    for low in range(0, len(both), 8192):
        m = []
        for r, w, ok, n in zip(row, where, known, (len(left), len(right)), strict=True):
            here = ok & (w >= low) & (w < low + 8192)
            one = np.zeros((n, min(8192, len(both) - low)), np.float32)
            one[r[here], w[here] - low] = 1
            m.append(one)
        out += m[0] @ m[1].T
    return out.astype(np.int64)


def _compare(rows: pa.Table, setup: Setup) -> pa.Table:
    """Links between the components of two chunks of a bucket. A component pair needs one link.

    A pair that shares several mixed buckets is compared in the first of them alone: ``earlier`` has the members'
    buckets before this one."""
    sides = rows.column("side").to_numpy()
    cls, comp, size = (rows.column(c).to_numpy() for c in ("cls", "component", "n"))
    items = rows.column("items").combine_chunks()
    if isinstance(items, pa.ChunkedArray):
        items = items.chunk(0)
    flat, at = items.values.to_numpy(), items.offsets.to_numpy()
    i = np.flatnonzero(sides != 1)
    j = np.flatnonzero(sides != 0)
    found: list[tuple[int, int]] = []
    if len(i) and len(j) and (len(np.unique(comp)) > 1):
        i, j = _unmet(rows.column("earlier"), i, j, comp)
    if len(i) and len(j):
        inter = _overlaps([flat[at[x] : at[x + 1]] for x in i], [flat[at[x] : at[x + 1]] for x in j])
        union = size[i][:, None] + size[j][None] - inter
        p, q = np.nonzero((100 * inter >= setup.percent * union) & (comp[i][:, None] != comp[j][None]))
        pair = np.sort(np.stack([comp[i[p]], comp[j[q]]]), axis=0)
        found = np.unique(pair, axis=1).T.tolist()
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def _unmet(earlier: pa.ChunkedArray, i: np.ndarray, j: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members of either side that have a partner of another component with which they share no bucket before."""
    lists = earlier.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
    side = [[flat[at[x] : at[x + 1]] for x in rows] for rows in (i, j)]
    met = _overlaps(*side) > 0 if sum(map(len, side[0])) and sum(map(len, side[1])) else np.zeros((len(i), len(j)), bool)
    new = ~met & (comp[i][:, None] != comp[j][None])
    return i[new.any(1)], j[new.any(0)]


def _linked(inter: Column, n: Column, m: Column, setup: Setup) -> Column:
    return F.lit(100) * inter >= F.lit(setup.percent) * (n + m - inter)


def _star_links(mates: DataFrame, classes: DataFrame, sets: DataFrame, setup: Setup) -> DataFrame:
    """Confirmed links of each class with the nearest of its buckets' outermost members."""
    pairs = mates.select("cls", F.explode(F.array("low", "high")).alias("other")).filter("cls <> other").distinct()
    near = classes.select("cls", "n", "sketch")
    far = near.select(F.col("cls").alias("other"), F.col("n").alias("m"), F.col("sketch").alias("other_sketch"))
    differ = sum((F.bit_count(F.col("sketch")[k].bitwiseXOR(F.col("other_sketch")[k])) for k in range(-(-math.prod(setup.bands) // 64))), F.lit(0))
    pairs = pairs.join(near, "cls").join(far, "other").filter(F.lit(setup.percent) * F.greatest("n", "m") <= F.lit(100) * F.least("n", "m"))
    pairs = pairs.withColumn("differ", differ).filter(F.col("differ") <= setup.differing_bits)
    best = F.row_number().over(W.partitionBy("cls").orderBy("differ", "other"))
    pairs = pairs.withColumn("place", best).filter(F.col("place") <= NEAREST).select("cls", "other", "n", "m")
    full = pairs.join(sets, "cls").join(sets.select(F.col("cls").alias("other"), F.col("items").alias("other_items")), "other")
    return full.filter(_linked(F.size(F.array_intersect("items", "other_items")), F.col("n"), F.col("m"), setup)).select(F.col("cls").alias("a"), F.col("other").alias("b"))


def _bucket_links(mates: DataFrame, sets: DataFrame, labels: DataFrame, setup: Setup) -> DataFrame:
    """Links between components that share a bucket, named by component."""
    known = mates.select("band", "cls", "n").join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    known = materialize(known)
    mixed = known.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("rows"), F.sum("n").alias("items")).filter("x <> y")
    mixed = mixed.select("band", F.greatest(F.ceil(F.col("rows") / CHUNK_ROWS), F.ceil(F.col("items") / CHUNK_SHINGLES)).cast("int").alias("chunks"))
    rows = known.join(mixed, "band")
    # bands carry their number's hash, so any fixed order of them will do; only buckets that are mixed count
    mine = rows.groupBy("cls").agg(F.array_sort(F.collect_set("band")).alias("all_bands"))
    rows = rows.join(mine, "cls").withColumn("earlier", F.filter("all_bands", lambda b: b < F.col("band"))).drop("all_bands")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int"))
    # chunk c meets every chunk: as the left one of those from c on, as the right one of those before; side 2 is a chunk with itself
    meets = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least(o, F.col("chunk")).alias("i"), F.greatest(o, F.col("chunk")).alias("j"), F.when(o == F.col("chunk"), 2).when(o > F.col("chunk"), 0).otherwise(1).alias("side")))
    rows = rows.withColumn("meet", F.explode(meets)).select("band", "meet.*", "cls", "component", "n", "earlier")

    def compare(rows: pa.Table) -> pa.Table:
        return _compare(rows, setup)

    return rows.join(sets, "cls").groupBy("band", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, setup: Setup = Setup()) -> DataFrame:
    """``(doc_id, row_key, n_shingles, component_id)`` of every row; row_key is the digest of the
    row's id and text."""
    return _grouped(docs, setup).drop("component")


def _grouped(docs: DataFrame, setup: Setup) -> DataFrame:
    """The same with ``component``, which names the group of rows with shingles even if it has no id."""
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce("text", F.lit(""))))
    keyed = docs.select("doc_id", "text", key.alias("row_key"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = keyed.mapInArrow(partial(_sign, setup=setup), f"doc_id {kind}, row_key string, n long, k1 long, k2 long, bands array<long>, sketch array<long>")
    signed = materialize(signed.withColumn("uid", F.monotonically_increasing_id()))
    names = signed.filter("n > 0").groupBy("k1", "k2").agg(F.min("uid").alias("cls"), F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    names = materialize(names)
    classes = signed.join(names.select(F.col("cls").alias("uid"), "cls"), "uid").select("cls", "n", "bands", "sketch", "row_key")
    banded = classes.select("cls", "n", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).filter("low <> high")
    mates = materialize(banded.join(buckets, "band"))
    wanted = mates.select("cls").distinct().join(classes.select("cls", "row_key"), "cls")
    texts = keyed.select("text", "row_key").join(wanted.hint("shuffle_hash"), "row_key").select("cls", "text")
    # rows with the same id and text come more than once
    sets = materialize(texts.mapInArrow(partial(_sets, setup=setup), "cls long, items array<long>").groupBy("cls").agg(F.first("items").alias("items")))
    links = materialize(_star_links(mates, classes, sets, setup))
    labels = components(links)
    more = materialize(_bucket_links(mates, sets, labels, setup).distinct())
    if more.limit(1).count():
        stars = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
        labels = components(stars.union(more))
    named = names.join(labels.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    named = materialize(named)
    roots = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = named.join(roots, "component").select("k1", "k2", "component_id", "component")
    rows = signed.select("doc_id", "row_key", "n", "k1", "k2")
    some, none = rows.filter("n > 0"), rows.filter("n = 0").withColumns({"component_id": F.lit(None).cast(kind), "component": F.lit(None).cast("long")})
    # the rows of a class of very many copies are dealt over parts by their ids
    hot = bounded(names.filter(F.col("copies") > HOT).select("k1", "k2", F.lit(True).alias("hot")))
    part = F.when(F.col("hot"), F.pmod(F.xxhash64("row_key"), F.lit(PARTS)).cast("int")).otherwise(0)
    parts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    some = some.join(hot, ["k1", "k2"], "left").withColumn("part", part).drop("hot")
    of_class = of_class.join(hot, ["k1", "k2"], "left").withColumn("part", F.explode(parts)).drop("hot")
    return (
        some.join(of_class, ["k1", "k2", "part"]).drop("part")
        .unionByName(none)
        .select("doc_id", "row_key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "component")
    )


def neardup_report(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs, Setup(words=3, percent=85))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, setup: Setup = Setup()) -> DataFrame:
    """``docs`` less all but one row of each group: of the least id, then of the least row_key; ids that are null come last.
    Rows without words are groups of their own; of those that repeat an id one row stays."""
    found = _grouped(docs.select("doc_id", "text"), setup)
    group = F.when(F.col("n_shingles") > 0, F.col("component").cast("string")).otherwise(F.col("row_key"))
    # rows without words and id aren't known to be the same document
    same = (F.col("n_shingles") > 0) | F.col("doc_id").isNotNull()
    rows = found.groupBy(group.alias("grp"), "row_key").agg(F.min("doc_id").alias("doc_id"), F.sum(same.cast("int")).alias("copies"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key", "copies"))
    keep = materialize(rows.groupBy("grp").agg(first.alias("x")).select(F.col("x.row_key").alias("__row_key"), F.col("x.copies").alias("__copies")))
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce("text", F.lit(""))))
    mark = unused(docs.columns, "__row_key")
    keyed = docs.withColumn(mark, key)
    keep = keep.withColumnRenamed("__row_key", mark)
    repeated = keep.filter("__copies > 1")
    if repeated.isEmpty():
        return keyed.join(keep.select(mark).hint("shuffle_hash"), mark, "left_semi").select(*docs.columns)
    once = keyed.join(keep.filter("__copies <= 1").select(mark).hint("shuffle_hash"), mark, "left_semi")
    more = keyed.join(repeated.select(mark).hint("shuffle_hash"), mark, "left_semi").dropDuplicates([mark])
    return once.union(more).select(*docs.columns)


OP10_SQL = """
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w
  from documents),
sets as (
  select doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) end) as s
  from words),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
classes as (select doc_id, n, min(doc_id) over (partition by n, h) as cls from (
  select doc_id, count(*) as n, md5(string_agg(s, '|' order by s)) as h from sets group by doc_id)),
reps as (select sets.* from sets join classes using (doc_id) where cls = doc_id),
pairs as (
  select a.doc_id as x, b.doc_id as y, count(*) as i
  from reps a join reps b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (
  select x, y from pairs join sizes p on p.doc_id = x join sizes q on q.doc_id = y
  where 100 * i >= 85 * (p.n + q.n - i)),
edges as (select x, y from links union all select y, x from links),
reach(node, root) as (
  select cls, cls from classes where cls = doc_id
  union
  select e.y, r.root from reach r join edges e on e.x = r.node),
roots as (select node, min(root) as root from reach group by node)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, coalesce(r.root, d.doc_id) as component_id,
  coalesce(r.root, d.doc_id) = d.doc_id as kept
from documents d left join sizes s using (doc_id) left join classes c on c.doc_id = d.doc_id left join roots r on r.node = c.cls
"""
