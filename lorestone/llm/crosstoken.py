"""Cross-tokenizer alignment: where the tokens of two tokenizers end together in a text.

Tokenizing is the one step in Python; the alignment is relational. Each document's tokens of either side are
exploded with their places, a window adds up their lengths to the bytes where they end, and the two sides meet in an
equi-join on document and end. The ends that both have, the cuts, are gathered by document as two places in one number each and
sorted; a cut's place among them is the group id of the tokens up to it, and the tokens that it joins are linked. Digests and links are
read off the ids and cuts in Arrow batches. Documents are dealt once, by row, as short arrays of token ids; joins and windows
keep to that partitioning.

The tokens of a text are those of its words: both tokenizers never put a token over a space between two
printable ASCII or two-byte characters, so a slice of texts is cut there and each distinct word is encoded once; such words
go to the first tokenizer as one text. A text counts as
encoded only if every word's tokens of either side spell the word.

How often an id pair is linked in the corpus is counted with partial sums; the counts go to all tasks only if they are
few, and are joined otherwise, each document's links being summed by pair first.

Defined results: null and empty texts, and texts that some side's tokens do not spell, have no tokens, zeros and an
empty digest; every row is a document, repeated ones too; an empty table gives no rows. Other columns than the id and the
text are not read. ``docs`` should be read from files, as rows are numbered by partition and place.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cache, partial
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lorestone.llm import wordvec as wv
from lorestone.llm.common import materialize

FOLDER = "/opt/tokenizers"
FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text whose words are encoded at a time, words whose tokens a worker remembers.
SLICE_BYTES, REMEMBERED = 1 << 21, 400_000
#: Bytes of text whose tokens a task sorts; some 50 times as much memory.
PART_BYTES = 2 << 20
#: Tokens that are written out for digests at a time; a longer document is taken alone.
SAID_TOKENS = 1 << 18
#: More than any id of a second vocabulary; what ids are less by while they are dealt.
SIDE, HALF = 1 << 16, 1 << 15
#: Pairs whose counts are sent to all tasks at most.
BROADCAST_PAIRS = 2_000_000
#: Fixed value: how a byte-level tokenizer of this kind splits a text before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PRINTABLE = np.array([33 <= b <= 126 for b in range(256)])
#: First bytes of two-byte characters of which none is white space, and the bytes that follow in any character.
_LETTER, _FOLLOWS = np.array([0xC3 <= b <= 0xDF for b in range(256)]), np.array([0x80 <= b <= 0xBF for b in range(256)])


@cache
def first_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary, whose characters stand for bytes: printable ones of Latin-1 for
    themselves, the others in turn for those from 256 on. Special tokens have none, as they are not used."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}
    held = json.loads(Path(path).read_text())
    vocabulary, special = held["model"]["vocab"], {t["content"] for t in held["added_tokens"]}
    out = [b""] * (1 + max([*vocabulary.values(), *(t["id"] for t in held["added_tokens"])]))
    for token, i in vocabulary.items():
        if token not in special:
            out[i] = bytes(byte[c] for c in token)
    return out


@cache
def second_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a vocabulary of pieces."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]


@dataclass
class _Coded:
    """Ids of a side's tokens, word after word, and where each word's end; or bytes of ids."""

    ids: np.ndarray
    ends: np.ndarray

    def of(self, pick: np.ndarray) -> _Coded:
        """Of the words at ``pick``."""
        begin = np.concatenate([[0], self.ends])[pick]
        n = self.ends[pick] - begin
        ends = np.cumsum(n)
        return _Coded(self.ids[np.repeat(begin - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], ends)

    def then(self, other: _Coded) -> _Coded:
        return _Coded(np.concatenate([self.ids, other.ids]), np.concatenate([self.ends, other.ends + len(self.ids)]))


def _coded(lists: list) -> _Coded:
    ends = np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))
    return _Coded(np.fromiter(chain.from_iterable(lists), np.int32, int(ends[-1]) if len(ends) else 0), ends)


def _spaced(words: pa.Array) -> np.ndarray:
    """The words' bytes, a space before each."""
    data, offsets = wv.buffers(words)
    out, body = np.full(len(data) + len(words), 32, np.uint8), np.ones(len(data) + len(words), bool)
    body[offsets[:-1] + np.arange(len(words))] = False
    out[body] = data
    return out


class _Encoder:
    """Both tokenizers, and the tokens of words met before. Ids go as 16-bit numbers, less HALF, so vocabularies
    may have 2 * HALF entries at most; a larger one is an error. A byte-level vocabulary's ids are the ranks of its merges."""

    def __init__(self, first: str, second: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from tiktoken import Encoding

        self.bytes = first_bytes(first), second_bytes(second)
        if max(map(len, self.bytes)) > 2 * HALF:
            raise ValueError(f"a vocabulary has more than {2 * HALF} entries")
        self.sizes = [np.array([len(b) for b in side]) for side in self.bytes]
        self.flat = [_Coded(np.frombuffer(b"".join(side), np.uint8), np.cumsum(n)) for side, n in zip(self.bytes, self.sizes, strict=True)]
        self.first = Encoding("first", pat_str=PATTERN, mergeable_ranks={b: i for i, b in enumerate(self.bytes[0]) if b}, special_tokens={})
        self.second = SentencePieceProcessor(model_file=second)
        self.met = pa.array([], pa.large_string())
        self.sides, self.spelt = [_coded([]), _coded([])], np.zeros(0, bool)

    def words(self, words: pa.Array) -> tuple[list[_Coded], np.ndarray]:
        """Ids of either side of each word with a space before it, and whether both spell that. Words are distinct."""
        found = pc.index_in(words, value_set=self.met)
        new = words.filter(found.is_null())
        fresh = self._encoded(new)
        place = found.to_numpy(zero_copy_only=False) if not found.null_count else pc.fill_null(found, -1).to_numpy()
        place = np.where(place < 0, len(self.met) + np.cumsum(place < 0) - 1, place)
        sides, spelt = [old.then(more) for old, more in zip(self.sides, fresh, strict=True)], np.concatenate([self.spelt, self._spell(new, fresh)])
        out = [side.of(place) for side in sides], spelt[place]
        if len(spelt) > REMEMBERED:  # the words at hand are what is remembered
            self.met, self.sides, self.spelt = words, *out
        else:
            self.met, self.sides, self.spelt = pa.concat_arrays([self.met, new]), sides, spelt
        return out

    def _encoded(self, words: pa.Array) -> list[_Coded]:
        listed = words.to_pylist()
        return [self._first(words, listed), _coded(self.second.encode(listed, num_threads=1))]

    def _first(self, words: pa.Array, listed: list[str]) -> _Coded:
        """Words with the edges that texts are cut between go as one text."""
        data, offsets = wv.buffers(words)
        if not len(words):
            return _coded([])
        head, last, before = data[offsets[:-1]], data[offsets[1:] - 1], data[np.maximum(offsets[1:] - 2, offsets[:-1])]
        plain = (_PRINTABLE | _LETTER)[head] & (_PRINTABLE[last] | _FOLLOWS[last] & _LETTER[before])
        text = _spaced(words if plain.all() else words.filter(pa.array(plain))).tobytes().decode()
        ids = self.first.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
        ends, want = np.cumsum(self.sizes[0][ids]), np.cumsum(np.diff(offsets)[plain] + 1)
        at = np.searchsorted(ends, want)
        if len(at) and (at[-1] != len(ends) - 1 or not np.array_equal(ends[at], want)):  # tokens that don't spell their words
            return _coded([self.first.encode_ordinary(f" {w}") for w in listed])
        alone = _coded([self.first.encode_ordinary(f" {listed[i]}") for i in np.flatnonzero(~plain).tolist()])
        both = _Coded(ids, at + 1).then(alone)
        return both if plain.all() else both.of(np.argsort(np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])))

    def _spell(self, words: pa.Array, sides: list[_Coded]) -> np.ndarray:
        """Whether both sides spell each word: their bytes are as many, and the same."""
        out, want, whole = np.ones(len(words), bool), np.diff(wv.buffers(words)[1]) + 1, _spaced(words)
        for of, sizes, side in zip(self.flat, self.sizes, sides, strict=True):
            out &= np.diff(np.concatenate([[0], np.cumsum(sizes[side.ids])])[np.concatenate([[0], side.ends])]) == want
            at = np.flatnonzero(out)
            if len(at):
                same = of.of(side.of(at).ids).ids == whole[np.repeat(out, want)]
                out[at] = np.logical_and.reduceat(same, np.cumsum(want[at]) - want[at])
        return out


def _cut(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The texts cut at single spaces between printable ASCII characters or letters of two bytes: words, and where each text's words begin."""
    cut = data[1:-1] == 32
    if len(cut) > 0:
        cut &= (_PRINTABLE[data[:-2]] | _FOLLOWS[data[:-2]] & np.concatenate([[False], _LETTER[data[:-3]]])) & (_PRINTABLE | _LETTER)[data[2:]]
    cut = np.concatenate([[False], cut, [False]])[: len(data)]
    full = offsets[:-1][np.diff(offsets) > 0]
    cut[full] = cut[offsets[1:][np.diff(offsets) > 0] - 1] = False  # no row's first or last character
    begins = cut.copy()
    begins[full] = True
    begin = np.flatnonzero(begins)
    gone = np.cumsum(cut)
    ends = np.append(begin - gone[begin] + cut[begin], len(data) - (gone[-1] if len(gone) else 0))
    return pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[~cut])), np.searchsorted(begin, offsets)


def _tokens(batches: Iterator[pa.RecordBatch], first: str, second: str) -> Iterator[pa.RecordBatch]:
    encoder = _Encoder(first, second)
    for batch in wv.slices(batches, most=SLICE_BYTES):
        words, at = _cut(*wv.buffers(batch.column("text")))
        coded = words.dictionary_encode()
        known, whole = encoder.words(coded.dictionary)
        pick = coded.indices.to_numpy()
        unspelt = np.concatenate([[0], np.cumsum(~whole[pick])])
        good = unspelt[at[1:]] == unspelt[at[:-1]]
        sides = []
        for side in known:
            all_ = side.of(pick)
            ids, ends = all_.ids, np.concatenate([[0], all_.ends])[at]
            size = np.where(good, np.diff(ends), 0)
            if not good.all():
                ids = ids[np.repeat(good, np.diff(ends))]
            sides.append((ids, size))
        lists = [wv.list_array((ids - HALF).astype(np.int16), np.concatenate([[0], np.cumsum(n)])) for ids, n in sides]
        text = pa.StructArray.from_arrays([batch.column("doc_id"), *lists], ["doc_id", "a", "b"])
        yield pa.RecordBatch.from_arrays([batch.column("uid"), text], ["uid", "text"])


def tokens(docs: DataFrame, first: str, second: str) -> DataFrame:
    """``(uid, text)``: a number for each row, and its id and the ids of both sides' tokens."""
    kind = docs.schema["doc_id"].dataType
    to_arrow_type(kind)  # an id that Arrow can't carry is an error here
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    return rows.mapInArrow(partial(_tokens, first=first, second=second), f"uid long not null, text struct<doc_id:{kind.simpleString()},a:array<smallint>,b:array<smallint>>")


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Joins on document and end keep to the partitioning by document, and the sides share one shuffle, whatever fields they read.
SETTINGS = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.optimizer.expression.nestedPruning.enabled": "false", "spark.sql.optimizer.nestedSchemaPruning.enabled": "false"}


def _lengths(spark: SparkSession, side: list[bytes]) -> DataFrame:
    """``(id, length)`` of a vocabulary: as many rows as it has entries, whatever the data."""
    return F.broadcast(spark.createDataFrame(pa.table({"id": pa.array(range(len(side)), pa.int32()), "length": pa.array([len(b) for b in side], pa.int32())})))


def _ends(dealt: DataFrame, side: str, lengths: DataFrame) -> DataFrame:
    """The tokens of a side with the byte where each ends."""
    rows = dealt.select("uid", F.posexplode_outer(F.col("text")[side]).alias("pos", "id")).withColumn("id", F.col("id").cast("int") + HALF).join(lengths, "id")
    end = F.sum("length").over(W.partitionBy("uid").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.select("uid", F.col("id").alias(side), F.col("pos").alias(f"pos_{side}"), end.cast("int").alias("end"))


@cache
def _written() -> pa.Array:
    """Each id in digits before a comma, then each before a bar and each before a semicolon."""
    return pa.array([f"{i}{mark}" for mark in ",|;" for i in range(2 * HALF)])


def _list(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of lists, and how many each has; none of a null."""
    return column.flatten().to_numpy(), pc.fill_null(pc.list_value_length(column), 0).to_numpy()


def _said(a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray, groups: np.ndarray) -> list[str]:
    """Digest of each document's groups. ``end_*``: where the groups' tokens end; ``groups``: how many each document has."""
    n_a, n_b, ends = np.diff(end_a, prepend=np.int32(0)), np.diff(end_b, prepend=np.int32(0)), end_a + end_b
    ids = np.empty(len(a) + len(b), np.int32)
    ids[np.repeat(end_b - n_b, n_a) + np.arange(len(a), dtype=np.int32)] = a
    ids[np.repeat(end_a, n_b) + np.arange(len(b), dtype=np.int32)] = b
    ids[ends - n_b - 1] += SIDE
    ids[ends - 1] += 2 * SIDE
    _, at, said = _written().take(pa.array(ids)).buffers()
    edges = np.frombuffer(at, np.int32)[np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(groups)])]].tolist()
    view = memoryview(said or b"")
    return [hashlib.sha256(view[u : v - 1]).hexdigest() if v > u else "" for u, v in zip(edges[:-1], edges[1:], strict=True)]  # no mark after the last group


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of documents with their tokens and cuts: sizes, digest and links, some SAID_TOKENS tokens at a time."""
    for whole in batches:
        doc_id, *both = whole.column("text").flatten()
        size, low = np.cumsum(sum(_list(x)[1].astype(np.int64) for x in both)), 0
        while low < whole.num_rows:
            high = max(low + 1, int(np.searchsorted(size, (size[low - 1] if low else 0) + SAID_TOKENS, "right")))
            cuts, groups = _list(whole.column("cuts")[low:high])
            sides = [_list(x[low:high]) for x in both]
            ids = [x.astype(np.int32) + HALF for x, _ in sides]
            places = [np.repeat(np.cumsum(n, dtype=np.int32) - n, groups) + place.astype(np.int32) for (_, n), place in zip(sides, (cuts >> 32, cuts & 0xFFFFFFFF), strict=True)]
            links = ids[0][places[0]].astype(np.int64) * SIDE + ids[1][places[1]]
            digests = _said(*ids, *(x + 1 for x in places), groups)
            numbers = [pa.array(n.astype(np.int64)) for n in (*(n for _, n in sides), groups)]
            columns = [whole.column("uid")[low:high], doc_id[low:high], *numbers, pa.array(digests, pa.string()), wv.list_array(links, np.concatenate([[0], np.cumsum(groups)]))]
            yield pa.RecordBatch.from_arrays(columns, ["uid", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])
            low = high


def align(docs: DataFrame, folder: str = FOLDER, first: str = FIRST, second: str = SECOND, part_bytes: int = PART_BYTES) -> DataFrame:
    """Per document ``(uid, doc_id, n_a, n_b, n_groups, groups_sha256, links)``, written; a link is the first id times SIDE plus the second.

    A cut's group is what either side has after the cut before it."""
    spark, paths = docs.sparkSession, [str(Path(folder, name)) for name in (first, second)]
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))
    dealt = tokens(docs, *paths).repartition(parts, "uid").sortWithinPartitions("uid")
    a, b = (_ends(dealt, side, _lengths(spark, of(path))) for side, of, path in zip("ab", (first_bytes, second_bytes), paths, strict=True))
    cut = F.shiftleft(F.col("pos_a").cast("long"), 32) + F.col("pos_b")  # in the order of the ends
    cuts = a.hint("merge").join(b, ["uid", "end"]).groupBy("uid").agg(F.sort_array(F.collect_list(cut)).alias("cuts"))
    documents = dealt.join(cuts.hint("merge"), "uid", "left").select("uid", "text", "cuts")
    with _settings(spark, SETTINGS):
        return materialize(documents.mapInArrow(_grouped, f"uid long, doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, links array<long>"))


def pair_counts(aligned: DataFrame, most: int = BROADCAST_PAIRS) -> tuple[DataFrame, bool]:
    """``(link, n, best)`` of every linked id pair, written: how many links it has, and whether no other pair of its second
    id has more; and whether there are at most ``most``."""
    pairs = materialize(aligned.select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("n")))
    second = F.col("link") % SIDE
    top = pairs.groupBy(second.alias("b")).agg(F.max("n").alias("top"))  # a row for each id of a vocabulary at most
    out = pairs.withColumn("b", second).join(F.broadcast(top), "b").select("link", "n", (F.col("n") == F.col("top")).alias("best"))
    return out, pairs.limit(most + 1).count() <= most


def align_report(docs: DataFrame, folder: str = FOLDER, first: str = FIRST, second: str = SECOND, most: int = BROADCAST_PAIRS) -> DataFrame:
    """Per document its tokens, groups and links, and how its links stand in the corpus."""
    aligned = align(docs.select("doc_id", "text"), folder, first, second)
    counts, few = pair_counts(aligned, most)
    links = aligned.select("uid", F.explode("links").alias("link"))
    if few:
        met = links.withColumn("times", F.lit(1)).join(F.broadcast(counts), "link")
    else:  # a document's equal links meet first; adaptive execution splits a frequent pair
        met = links.groupBy("uid", "link").agg(F.count("*").alias("times")).join(counts, "link")
    sums = met.groupBy("uid").agg(F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    out = aligned.drop("links").join(sums, "uid", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", none("n_links"), none("n_best"), none("count_sum"), "groups_sha256")
