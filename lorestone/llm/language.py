"""Language of every word by a linear-chain conditional random field.

A word's features are its affixes, its character 3-grams and its entry in a lexicon of the fitted
sample; transitions between languages are learned. Forward-backward sums over the whole text, across
its lines, label the words, and the words' chances, weighted by letters, make the text's language.
Weights are fitted by gradient ascent on a bounded sample of texts, whose words carry the text's
language; runs of their words in random order are the code-switched chains that steps are learned from.

Defined results: null texts and texts without letters are ``und`` with score 0; with nothing to
learn from, all texts are ``und``; languages that tie go by name; repeated rows agree; an empty
table gives no rows. Only the id and the text are read by a prediction.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorestone.llm import wordvec as wv
from lorestone.llm.common import crc_mod, fit_sample, materialize

#: Texts that a fit takes at most, of each language and of all together; texts of more characters come after all others.
#: All languages are learned; more than ``MOST_LANGUAGES``, whose weights would not fit a task, are an error.
FIT_ROWS, FIT_TOTAL, FIT_CHARS, MOST_LANGUAGES = 250, 10_000, 6_000, 1_000
BUCKET_BITS, LEXICON = 15, 20_000
#: Words of a run, runs of a chain that is learned from, and numbers that the messages of chains read together have at most.
RUN, RUNS, MESSAGES = 40, 24, 1 << 23
SEED = 7
AFFIX, GRAM = 3, 3
ROUNDS, RATE, DECAY = 12, 0.3, 1e-5


@dataclass
class Features:
    """Distinct words with their buckets, and the texts that they make up."""

    distinct: np.ndarray  # distinct word of each word
    key: np.ndarray  # hash of each distinct word
    bucket: np.ndarray
    bucket_first: np.ndarray
    letters: np.ndarray  # bytes of each distinct word
    first: np.ndarray  # words of text i are first[i] to first[i + 1]


def prepare(column: pa.Array) -> Features:
    data, offsets = wv.buffers(column)
    data = wv.LOWER[data]
    words = wv.split(data, offsets, _WORD)
    hashed = wv.hashes(data, words)
    key, at, distinct = np.unique(hashed, return_index=True, return_inverse=True)
    start, size = words.start[at], words.end[at] - words.start[at]
    buckets, owners = [], []
    everyone = np.arange(len(key))

    def add(salt: int, code: np.ndarray, owner: np.ndarray) -> None:
        buckets.append((wv.mix64(code * np.uint64(64) + np.uint64(salt)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
        owners.append(owner)

    byte = lambda p, ok: np.where(ok, data[np.where(ok, p, 0)] if len(data) else 0, 1).astype(np.uint64)
    for n in range(1, AFFIX + 1):  # prefixes and suffixes
        for salt, p in ((n, start), (8 + n, start + size - n)):
            code = np.zeros(len(key), np.uint64)
            for j in range(n):
                code = code * np.uint64(257) + byte(p + j, size > (j if salt < 8 else n - 1))
            add(salt, code, everyone)
    n = np.maximum(size + 2 - GRAM + 1, 1)
    begin = np.concatenate([[0], np.cumsum(n)])
    owner = np.repeat(everyone, n)
    offset = np.arange(begin[-1]) - begin[owner] - 1
    code = np.zeros(len(owner), np.uint64)
    for j in range(GRAM):
        p = offset + j
        code = code * np.uint64(257) + byte(start[owner] + p, (p >= 0) & (p < size[owner]))
    add(20, code, owner)
    bucket, owner = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    count = np.bincount(owner, minlength=len(key))
    return Features(distinct, key, bucket[order], np.concatenate([[0], np.cumsum(count)]), size.astype(np.float64), words.first)


#: Letters only: ASCII letters and all bytes beyond ASCII.
_WORD = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])


@dataclass
class Read:
    """What the chains say: labels' chances of every word, if kept; the labels' letters of every chain; expected steps."""

    chance: np.ndarray | None
    share: np.ndarray
    steps: np.ndarray


def read_chains(emit: np.ndarray, distinct: np.ndarray, letters: np.ndarray, step: np.ndarray, first: np.ndarray, keep: bool = False) -> Read:
    """Forward-backward sums over whole chains, words first[i] to first[i + 1], of which ``distinct`` names the kind.

    ``emit`` has exponentiated scores of each kind's labels (the greatest 1), ``letters`` its size, ``step`` the
    exponentiated step scores. Chains are read side by side, word by word. Only the forward messages are held."""
    k, n_chains = emit.shape[1], len(first) - 1
    out = Read(np.zeros((len(distinct), k), emit.dtype) if keep else None, np.zeros((n_chains, k)), np.zeros((k, k)))
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    order = order[length[order] > 0]
    size = length[order]
    low = 0
    while low < len(order):  # chains of like length together: so many that the messages stay in bounds, but one at least
        high = max(low + 1, min(len(order), low + MESSAGES // (int(size[low]) * k)))
        rows, begin, n = order[low:high], first[order[low:high]], int(size[low])
        live = np.searchsorted(-size[low:high], -np.arange(n), "left")  # longer chains come first
        at = np.concatenate([[0], np.cumsum(live)])
        forward = np.empty((at[-1], k), emit.dtype)
        x = emit[distinct[begin]]
        forward[: at[1]] = x / x.sum(1, keepdims=True)
        for t in range(1, n):
            x = (forward[at[t - 1] : at[t - 1] + live[t]] @ step) * emit[distinct[begin[: live[t]] + t]]
            forward[at[t] : at[t + 1]] = x / x.sum(1, keepdims=True)
        back = np.ones((int(live[n - 1]), k), emit.dtype)
        for t in range(n - 1, -1, -1):
            m = int(live[t])
            if len(back) < m:
                back = np.concatenate([back, np.ones((m - len(back), k), emit.dtype)])
            kind = distinct[begin[:m] + t]
            both = forward[at[t] : at[t + 1]] * back
            both /= both.sum(1, keepdims=True)
            out.share[rows[:m]] += both * letters[kind][:, None]
            if keep:
                out.chance[begin[:m] + t] = both
            if t:
                right = emit[kind] * back
                if keep:
                    before = forward[at[t - 1] : at[t - 1] + m]
                    out.steps += step * (before.T @ (right / ((before @ step) * right).sum(1, keepdims=True)))
                back = right @ step.T
                back /= back.sum(1, keepdims=True)
        low = high
    return out


def chain(score: np.ndarray, step: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chances of the labels of every word, and the expected number of each step, where every word has its own scores."""
    read = read_chains(score, np.arange(len(score)), np.ones(len(score)), step, first, keep=True)
    return read.chance, read.steps


@dataclass
class Field:
    languages: list[str]
    weights: np.ndarray  # (buckets + 1, languages); the last row is the constant
    lexicon: np.ndarray  # sorted hashes
    entries: np.ndarray  # (lexicon + 1, languages); the last row is of words that aren't in it
    step: np.ndarray

    def scores(self, f: Features) -> np.ndarray:
        """Of the distinct words."""
        if not len(f.key):
            return np.zeros((0, len(self.languages)), np.float32)
        mean = np.add.reduceat(self.weights[f.bucket], f.bucket_first[:-1]) / np.sqrt(np.diff(f.bucket_first))[:, None].astype(np.float32)
        return mean + self.weights[-1] + self.entries[self.place(f.key)]

    def place(self, key: np.ndarray) -> np.ndarray:
        if not len(self.lexicon):
            return np.zeros(len(key), np.int64)
        at = np.minimum(np.searchsorted(self.lexicon, key), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == key, at, len(self.lexicon))

    def read(self, f: Features, keep: bool = False) -> Read:
        score = self.scores(f)
        emit = np.exp(score - score.max(1, keepdims=True)) if len(score) else score
        return read_chains(np.maximum(emit, 1e-12), f.distinct, f.letters, np.exp(self.step), f.first, keep)

    def predict(self, f: Features) -> tuple[np.ndarray, np.ndarray]:
        """Language (-1: none) and its share of each text."""
        share = self.read(f).share
        some = np.diff(f.first) > 0
        best = share.argmax(1)
        return np.where(some, best, -1), np.where(some, share[np.arange(len(best)), best] / np.maximum(share.sum(1), 1e-12), 0.0)


def mixed_chains(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chains of code-switched text to learn steps from: the texts' runs of RUN words in random order, RUNS of them a
    chain. The words' old places, and where the chains begin."""
    length = np.diff(first)
    runs = -(-length // RUN)
    text = np.repeat(np.arange(len(length)), runs)
    begin = first[text] + (np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs)) * RUN
    order = np.random.default_rng(SEED).permutation(len(text))
    begin, size = begin[order], np.minimum(RUN, first[text + 1] - begin)[order]
    edge = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(edge[-1]) + np.repeat(begin - edge[:-1], size)
    return place, np.unique(np.append(edge[::RUNS], edge[-1]))


def fit(texts: list[str], languages: list[str]) -> Field:
    names = sorted(set(languages))
    k = len(names)
    if not k:
        return Field([], np.zeros((0, 0)), np.zeros(0, np.uint64), np.zeros((1, 0)), np.zeros((0, 0)))
    f = prepare(pa.array(texts, pa.string()))
    label = np.array([names.index(x) for x in languages])
    truth = np.repeat(label, np.diff(f.first))
    use = np.bincount(f.distinct, minlength=len(f.key))
    common = np.sort(np.argsort(-use, kind="stable")[:LEXICON])
    common = common[use[common] > 1]
    field = Field(names, np.zeros(((1 << BUCKET_BITS) + 1, k), np.float32), f.key[common], np.zeros((len(common) + 1, k), np.float32), np.zeros((k, k), np.float32))
    place, f.first = mixed_chains(f.first)
    f.distinct, truth = f.distinct[place], truth[place]
    piece = np.repeat(np.arange(len(f.first) - 1), np.diff(f.first))
    seen = np.zeros((k, k))
    inner = np.flatnonzero(piece[1:] == piece[:-1])
    np.add.at(seen, (truth[inner], truth[inner + 1]), 1)
    per_language = np.bincount(truth, minlength=k)
    balance = (len(truth) / (k * np.maximum(per_language, 1)))[truth].astype(np.float32)
    place, owner = field.place(f.key), np.repeat(np.arange(len(f.key)), np.diff(f.bucket_first))
    root = (1 / np.sqrt(np.diff(f.bucket_first)))[:, None]
    params = (field.weights, field.entries, field.step)
    grown = [np.zeros_like(p, np.float64) for p in params]
    for _ in range(ROUNDS):  # each weight has its own rate, by the squares of its slopes so far
        read = field.read(f, keep=True)
        miss = -read.chance * balance[:, None]
        miss[np.arange(len(truth)), truth] += balance
        word = np.stack([np.bincount(f.distinct, weights=miss[:, j], minlength=len(f.key)) for j in range(k)], axis=1) / max(1, len(truth))
        of_bucket = np.stack([np.bincount(f.bucket, weights=(word * root)[owner, j], minlength=(1 << BUCKET_BITS) + 1) for j in range(k)], axis=1)
        of_bucket[-1] = word.sum(0)
        of_entry = np.stack([np.bincount(place, weights=word[:, j], minlength=len(common) + 1) for j in range(k)], axis=1)
        of_entry[-1] = 0
        for p, slope, g in zip(params, (of_bucket, of_entry, (seen - read.steps) / max(1, len(truth))), grown, strict=True):
            slope = slope - DECAY * p
            g += slope**2
            p += (RATE * slope / (np.sqrt(g) + 1e-7)).astype(np.float32)
    return field


def train(docs: DataFrame, folds: int = 3, held_out: int = 1, rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> Field:
    """Fit on at most ``rows`` texts of each language, fewer where there are so many languages that FIT_TOTAL binds."""
    pool = docs.filter(F.col("lang").isNotNull() & (crc_mod(F.col("doc_id"), folds) != held_out)).select("doc_id", "text", F.col("lang").alias("y"))
    ids = materialize(pool.select("doc_id", "y", F.length("text").alias("size")).filter("size is not null"))
    n = ids.select("y").distinct().limit(MOST_LANGUAGES + 1).count()
    if n > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    sample, _ = fit_sample(ids, pool, max(1, min(rows, FIT_TOTAL // max(1, n))), chars)
    return fit([t for t, _ in sample], [y for _, y in sample])


def _letterless(column: pa.Array) -> np.ndarray:
    """Texts without ASCII letters, which may yet have others."""
    data, offsets = wv.buffers(column)
    total = np.concatenate([[0], np.cumsum(_WORD[wv.LOWER[data]])])
    ascii_only = np.concatenate([[0], np.cumsum(_WORD[wv.LOWER[data]] & (data < 128))])
    out = total[offsets[1:]] == total[offsets[:-1]]
    for i in np.flatnonzero(~out & (ascii_only[offsets[1:]] == ascii_only[offsets[:-1]])):
        out[i] = not any(unicodedata.category(c)[0] == "L" for c in column[i].as_py())
    return out


def _predict(batches: Iterator[pa.RecordBatch], field: Broadcast) -> Iterator[pa.RecordBatch]:
    names = field.value.languages
    # long chains cost a step each, which a larger slice shares among more texts; with many languages it would not fit
    for batch in wv.slices(batches, most=wv.SLICE_BYTES * max(1, 16 // max(4, len(names)))):
        if names:
            best, score = field.value.predict(prepare(batch.column("text")))
            best = np.where(_letterless(batch.column("text")), -1, best)
        else:
            best, score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
        said = pa.array(np.append(np.array(names, object), "und")[best].tolist(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), said, pa.array(np.where(best < 0, 0.0, score))], ["doc_id", "held_out", "lang_pred", "score"])


def label_words(text: str, field: Field) -> list[tuple[str, str, float]]:
    """The words of one text with their languages and chances."""
    f = prepare(pa.array([text]))
    raw = text.encode()
    data = wv.LOWER[np.frombuffer(raw, np.uint8)]
    words = wv.split(data, np.array([0, len(raw)]), _WORD)
    chance = field.read(f, keep=True).chance
    return [(raw[a:b].decode(), field.languages[c.argmax()], float(c.max())) for a, b, c in zip(words.start, words.end, chance, strict=True)]


def language_report(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text", "lang")
    field = docs.sparkSession.sparkContext.broadcast(train(docs))
    kind = docs.schema["doc_id"].dataType.simpleString()
    marked = docs.select("doc_id", "text", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"))
    return marked.mapInArrow(partial(_predict, field=field), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
