"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as the embedding of itself, if it is in the fitted vocabulary, beside the mean
embedding of its character 4-grams, which any word has. Two gated recurrent layers read each window
from either end, attention pools their states, and a logistic unit gives the window's logit. Texts
are cut into overlapping windows over all their words; the largest logit, put through a logistic
curve, is the text's score.

The fit uses a bounded sample of labelled rows, of near copies only one. Only whole documents are
labelled, so each round takes a toxic document's strongest window as its example, and all windows
of the others as counterexamples.

Defined results: null and empty texts, and texts without words, are one window without words;
repeated rows score alike; without two labels to learn from, all texts score the same; an empty
table gives no rows. Other columns than the id and the text are not read by a score.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorestone.llm import wordvec as wv
from lorestone.llm.common import crc_mod, labelled_ids, sample_table, unused

#: Labelled rows of either label that a fit takes at most; texts of more characters come after all others.
FIT_ROWS, FIT_CHARS = 1500, 12_000
WINDOW, STRIDE = 48, 32
#: Words of the vocabulary at most. Each is in a share of the fitted texts, or leans to one label by so many standard
#: deviations, as chance alone lets hardly any word do; the net would learn texts by heart from other words.
VOCABULARY, LEAST_TEXTS, COMMON, BEYOND_CHANCE, WORD_DIM = 6000, 20, 0.02, 4.0, 10
GRAMS, GRAM_DIM, GRAM = 1 << 13, 6, 4
HIDDEN, ATTEND = 10, 8
ROUNDS, BATCH, RATE = 5, 256, 0.01
#: A small sample is gone over more often, for so many steps at least.
LEAST_STEPS = 200
#: Counts that are added to both labels' document counts of a word.
PRIOR = 4.0
THRESHOLD = 0.7
SEED = 7


@dataclass
class Batch:
    """Words of a few texts: which vocabulary entry, which distinct word, whose character grams."""

    entry: np.ndarray
    distinct: np.ndarray
    grams: np.ndarray
    grams_first: np.ndarray
    windows: np.ndarray  # (windows, WINDOW) places of words, -1 past the end
    first: np.ndarray  # windows of row i are first[i] to first[i + 1]
    hashed: np.ndarray
    words_first: np.ndarray


def prepare(column: pa.Array, vocabulary: np.ndarray) -> Batch:
    data, offsets = wv.buffers(column)
    data = wv.LOWER[data]
    words = wv.split(data, offsets, wv.ALNUM)
    hashed = wv.hashes(data, words)
    entry = np.full(len(hashed), len(vocabulary), np.int64)
    _, at, distinct = np.unique(hashed, return_index=True, return_inverse=True)
    if len(vocabulary):
        key = hashed[at]
        place = np.minimum(np.searchsorted(vocabulary, key), len(vocabulary) - 1)
        entry = np.where(vocabulary[place] == key, place, len(vocabulary))[distinct]
    # grams of each distinct word between two marks
    size = words.end[at] - words.start[at]
    n = np.maximum(size + 2 - GRAM + 1, 1)
    grams_first = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(at)), n)
    offset = np.arange(grams_first[-1]) - grams_first[row] - 1
    code = np.zeros(len(row), np.uint64)
    for j in range(GRAM):
        p = offset + j
        inside = (p >= 0) & (p < size[row])
        byte = np.where(inside, data[np.where(inside, words.start[at][row] + p, 0)] if len(data) else 0, 1)
        code = code * np.uint64(257) + byte.astype(np.uint64)
    grams = (wv.mix64(code) >> np.uint64(64 - 13)).astype(np.int64)
    count = np.diff(words.first)
    n_windows = 1 + np.maximum(0, -(-(count - WINDOW) // STRIDE))
    first = np.concatenate([[0], np.cumsum(n_windows)])
    owner = np.repeat(np.arange(len(count)), n_windows)
    begin = words.first[owner] + (np.arange(first[-1]) - first[owner]) * STRIDE
    windows = begin[:, None] + np.arange(WINDOW)[None]
    windows = np.where(windows < words.first[owner + 1][:, None], windows, -1)
    return Batch(entry, distinct, grams, grams_first, windows, first, hashed, words.first)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    vocabulary: np.ndarray
    p: dict[str, np.ndarray] = field(default_factory=dict)
    slope: float = 0.0
    shift: float = 0.0

    @classmethod
    def new(cls, vocabulary: np.ndarray, lean: np.ndarray) -> Network:
        rng, d, h = np.random.default_rng(SEED), WORD_DIM + GRAM_DIM, HIDDEN
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        p = {"word": draw(len(vocabulary) + 1, WORD_DIM, scale=0.05), "gram": draw(GRAMS, GRAM_DIM, scale=0.1)}
        p["word"][-1] = 0
        p["word"][:-1, 0] = lean
        for way in "fb":
            p |= {f"w{way}": draw(d, 3 * h, scale=d**-0.5), f"u{way}": draw(h, 3 * h, scale=h**-0.5), f"c{way}": np.zeros(3 * h, np.float32)}
        p |= {"a": draw(2 * h, ATTEND, scale=h**-0.5), "v": draw(ATTEND, scale=0.5), "o": draw(2 * h, scale=0.3), "o0": np.zeros(1, np.float32)}
        return cls(vocabulary, p)

    def inputs(self, b: Batch) -> np.ndarray:
        """Embeddings of the distinct words' characters."""
        if not len(b.grams):
            return np.zeros((0, GRAM_DIM), np.float32)
        return np.add.reduceat(self.p["gram"][b.grams], b.grams_first[:-1]) / np.diff(b.grams_first)[:, None].astype(np.float32)

    def forward(self, b: Batch, rows: np.ndarray, chars: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Logits of the windows named; with ``keep``, what the backward pass needs. Time is axis 0."""
        p, h = self.p, HIDDEN
        place = b.windows[rows].T
        live = place >= 0
        if len(b.entry):
            at = np.where(live, place, 0)
            x = np.concatenate([p["word"][b.entry[at]], chars[b.distinct[at]]], axis=2)
        else:
            x = np.zeros((*place.shape, WORD_DIM + GRAM_DIM), np.float32)
        x *= live[:, :, None]
        n, m, kept, both = len(place), len(rows), {}, []
        for way in "fb":
            gates = (x.reshape(n * m, -1) @ p[f"w{way}"]).reshape(n, m, 3 * h) + p[f"c{way}"]
            state = np.zeros((m, h), np.float32)
            out = np.zeros((n, m, h), np.float32)
            trace = []
            for t in range(n) if way == "f" else range(n - 1, -1, -1):
                u = state @ p[f"u{way}"]
                zr = _sigmoid(gates[t, :, : 2 * h] + u[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                new = np.tanh(gates[t, :, 2 * h :] + r * u[:, 2 * h :])
                old, state = state, np.where(live[t, :, None], new + z * (state - new), state)
                out[t] = state
                if keep:
                    trace.append((t, z, r, new, u[:, 2 * h :], old))
            both.append(out)
            kept[way] = trace
        hidden = np.concatenate(both, axis=2)
        seen = np.tanh(hidden @ p["a"])
        score = np.where(live, seen @ p["v"], -1e9)
        weight = np.exp(score - score.max(0))
        weight *= live
        weight /= np.maximum(weight.sum(0), 1e-9)
        pooled = (weight[:, :, None] * hidden).sum(0)
        logit = pooled @ p["o"] + p["o0"][0]
        return logit, kept | {"x": x, "hidden": hidden, "seen": seen, "weight": weight, "pooled": pooled, "live": live, "place": place} if keep else {}

    def slopes(self, b: Batch, kept: dict, error: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of a loss whose slope in each logit is ``error``."""
        p, h, live = self.p, HIDDEN, kept["live"]
        g = {"o": kept["pooled"].T @ error, "o0": np.array([error.sum()], np.float32)}
        d_pooled = error[:, None] * p["o"]
        d_hidden = kept["weight"][:, :, None] * d_pooled[None]
        d_weight = (kept["hidden"] * d_pooled[None]).sum(2)
        d_score = kept["weight"] * (d_weight - (kept["weight"] * d_weight).sum(0))
        d_seen = d_score[:, :, None] * p["v"] * (1 - kept["seen"] ** 2)
        g["v"] = (d_score[:, :, None] * kept["seen"]).sum((0, 1))
        flat = lambda a: a.reshape(-1, a.shape[-1])
        g["a"] = flat(kept["hidden"]).T @ flat(d_seen)
        d_hidden += d_seen @ p["a"].T
        d_x = np.zeros_like(kept["x"])
        for k, way in enumerate("fb"):
            u_t, later = p[f"u{way}"].T, np.zeros((live.shape[1], h), np.float32)
            d_gates = np.zeros((*live.shape, 3 * h), np.float32)
            g[f"u{way}"] = np.zeros_like(p[f"u{way}"])
            for t, z, r, new, u_new, old in reversed(kept[way]):
                total = d_hidden[t, :, k * h : (k + 1) * h] + later
                on = live[t, :, None]
                d = np.where(on, total, 0)
                d_new = d * (1 - z) * (1 - new**2)
                d_zr = np.concatenate([d * (old - new) * z * (1 - z), d_new * u_new * r * (1 - r)], axis=1)
                d_u = np.concatenate([d_zr, d_new * r], axis=1)
                d_gates[t] = np.concatenate([d_zr, d_new], axis=1)
                g[f"u{way}"] += old.T @ d_u
                later = np.where(on, d * z + d_u @ u_t, total)
            g[f"w{way}"], g[f"c{way}"] = flat(kept["x"]).T @ flat(d_gates), flat(d_gates).sum(0)
            d_x += d_gates @ p[f"w{way}"].T
        at, d_x = kept["place"][live], d_x[live]
        g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        np.add.at(g["word"], b.entry[at], d_x[:, :WORD_DIM])
        g["word"][-1] = 0
        per_word = np.zeros((len(b.grams_first) - 1, GRAM_DIM), np.float32)
        np.add.at(per_word, b.distinct[at], d_x[:, WORD_DIM:])
        used = np.flatnonzero(per_word.any(1))
        n = np.diff(b.grams_first)
        if len(used):
            which = np.concatenate([np.arange(b.grams_first[i], b.grams_first[i + 1]) for i in used])
            np.add.at(g["gram"], b.grams[which], np.repeat(per_word[used] / n[used, None], n[used], axis=0))
        return g

    def logits(self, b: Batch, rows: np.ndarray | None = None, most: int = 2048) -> np.ndarray:
        rows = np.arange(len(b.windows)) if rows is None else rows
        chars = self.inputs(b)
        parts = [self.forward(b, rows[a : a + most], chars)[0] for a in range(0, len(rows), most)]
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def score(self, b: Batch) -> np.ndarray:
        if not len(b.first) - 1:
            return np.zeros(0)
        top = np.maximum.reduceat(self.logits(b), b.first[:-1]).astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(self.slope * top + self.shift, -30, 30)))


def _distinct_texts(column: pa.Array) -> np.ndarray:
    """Rows that share none of a few least shingles with a row before."""
    seen: set[int] = set()
    kept, i = [], 0
    for batch in wv.slices(iter([pa.record_batch([column], ["text"])])):
        data, offsets = wv.buffers(batch.column("text"))
        words = wv.split(data, offsets)
        sets, begin = wv.shingles(wv.hashes(data, words), words.first, 3)
        for a, b in zip(begin[:-1], begin[1:], strict=True):
            keys = {int(wv.mix64(sets[a:b] + np.uint64(s)).min()) ^ s for s in range(1, 5)} if b > a else set()
            if not keys & seen:
                kept.append(i)
            seen |= keys
            i += 1
    return np.array(kept, np.int64)


def fit(texts: list[str], labels: list[int], share: float | None = None) -> Network:
    """``share``: of toxic rows where scores are used; by default as among the labels."""
    empty = Network.new(np.zeros(0, np.uint64), np.zeros(0, np.float32))
    if len(set(labels)) < 2:
        empty.shift = 3.0 if labels and labels[0] else -3.0
        return empty
    column, y = pa.array(texts, pa.string()), np.array(labels, np.int64)
    kept = _distinct_texts(column)
    if len(set(y[kept].tolist())) == 2:
        column, y = column.take(pa.array(kept)), y[kept]
    first = prepare(column, np.zeros(0, np.uint64))
    row = np.repeat(np.arange(len(y)), np.diff(first.words_first))
    words = np.unique(first.hashed)
    pair = np.unique(np.searchsorted(words, first.hashed) * len(y) + row)
    counts = [np.bincount(pair // len(y), weights=y[pair % len(y)] == k, minlength=len(words)) for k in (0, 1)]
    total = [(y == k).sum() for k in (0, 1)]
    lean = np.log((counts[1] + PRIOR) / (counts[0] * total[1] / total[0] + PRIOR))
    used, part = counts[0] + counts[1], total[1] / len(y)
    beyond = np.abs(counts[1] - used * part) / np.sqrt(used * part * (1 - part) + 1e-9)
    common = used >= max(LEAST_TEXTS, COMMON * len(y))
    by_use = np.argsort(-used * common, kind="stable")[: min(VOCABULARY // 2, int(common.sum()))]
    by_lean = np.argsort(-beyond, kind="stable")[: min(VOCABULARY // 2, int((beyond >= BEYOND_CHANCE).sum()))]
    chosen = np.unique(np.concatenate([by_use, by_lean]))
    net = Network.new(words[chosen], lean[chosen].astype(np.float32))
    batch = prepare(column, net.vocabulary)
    rng = np.random.default_rng(SEED)
    owner = np.repeat(np.arange(len(y)), np.diff(batch.first))
    # before the first round, a window is as strong as its strongest word
    at = np.where(batch.windows >= 0, batch.windows, 0)
    strength = (np.append(net.p["word"][:-1, 0], 0)[batch.entry[at]] * (batch.windows >= 0)).max(1)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    step = 0
    a_round = len(batch.windows) * 4 // (3 * BATCH) + 1
    rounds = max(ROUNDS, -(-LEAST_STEPS // a_round))
    for k in range(rounds):
        best = np.lexsort((strength, owner))[batch.first[1:] - 1]
        positive, negative = best[y == 1], np.flatnonzero(y[owner] == 0)
        # as many windows of either label in the mean, all of them once a round
        examples = np.concatenate([np.repeat(positive, max(1, len(negative) // (3 * max(1, len(positive))))), negative])
        rng.shuffle(examples)
        for a in range(0, len(examples), BATCH):
            rows = examples[a : a + BATCH]
            if a % (8 * BATCH) == 0:  # characters' embeddings are summed up now and then
                chars = net.inputs(batch)
            logit, kept_ = net.forward(batch, rows, chars, keep=True)
            g = net.slopes(batch, kept_, ((_sigmoid(logit) - y[owner[rows]]) / len(rows)).astype(np.float32))
            step += 1
            for name, slope in g.items():
                m[name] = 0.9 * m[name] + 0.1 * slope
                v[name] = 0.999 * v[name] + 0.001 * slope * slope
                net.p[name] -= RATE * (1 - k / rounds) * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-6)
        strength = net.logits(batch)
    top = np.maximum.reduceat(strength, batch.first[:-1]).astype(np.float64)
    share = min(max(share if share is not None else y.mean(), 0.01), 0.99)
    weight = np.where(y == 1, share / (y == 1).sum(), (1 - share) / (y == 0).sum())
    mid, spread = np.average(top, weights=weight), max(top.std(), 1e-6)
    x = (top - mid) / spread
    a, c = 1.0, 0.0
    for _ in range(2000):
        p = 1 / (1 + np.exp(-np.clip(a * x + c, -30, 30)))
        a += 1.0 * float((weight * (y - p) * x).sum())
        c += 1.0 * float((weight * (y - p)).sum())
    net.slope = max(a, 0.05) / spread
    net.shift = c - net.slope * mid
    return net


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> Network:
    """Fit, in a task, on at most ``rows`` documents of either label; the share of toxic ones is that of all that may be
    learned from. The driver gets the network alone."""
    ids = labelled_ids(docs, labels, "toxic", crc_mod(F.col("doc_id"), 3) != 1)
    sample, ids = sample_table(ids, docs.select("doc_id", "text"), rows, chars)
    if sample is None:
        return fit([], [])
    share = ids.select("doc_id", "y").distinct().agg(F.avg("y")).first()[0] or 0.0
    one = sample.repartition(1).sortWithinPartitions("doc_id", "y").select("text", "y")
    return pickle.loads(one.mapInArrow(partial(_fitted, share=share), "net binary").first()[0])


def _fitted(batches: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    rows = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    if rows:
        net = fit([t for t, _ in rows], [y for _, y in rows], share)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], ["net"])


def _score(batches: Iterator[pa.RecordBatch], net: Broadcast, column: str) -> Iterator[pa.RecordBatch]:
    for batch in wv.slices(batches):
        score = net.value.score(prepare(batch.column("text"), net.value.vocabulary))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, column])


def scored(docs: DataFrame, net: Network, column: str = "toxic_score") -> DataFrame:
    """``docs`` with its scores in ``column``, which replaces one of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    docs = docs.drop(column)
    schema = docs.withColumn(column, F.lit(0.0)).schema
    return docs.mapInArrow(partial(_score, net=shared, column=column), schema)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    net = train(docs, labels)
    marked = docs.withColumn("held_out", crc_mod(F.col("doc_id"), 3) == 1)
    out = scored(marked, net).withColumnRenamed("toxic_score", "score")
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` less those that score the threshold or more."""
    score = unused(docs.columns, "toxic_score")
    return scored(docs, train(docs, labels), score).filter(F.col(score) < threshold).select(*docs.columns)
