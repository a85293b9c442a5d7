"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are its own and those of the lines before and after
it; two-state forward-backward sums give the chance that it is good, and the chances, weighted by
the lines' lengths, make the document's quality. The field is fitted by gradient ascent on a bounded
sample of labelled documents, whose lines all carry the document's label, so that steps come to say
how much a line is like the one before (documents joined to chains, whose steps change labels, made
held-out documents 0.3% worse); a logistic curve fitted on the same sample then maps mean chances to
document labels.

Defined results: a null or empty text is one empty line; a text without any labelled example to
learn from scores by a field of weights 0; repeated rows score alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorestone.llm import wordvec as wv
from lorestone.llm.common import crc_mod, fit_sample, labelled_ids

#: Labelled rows of either label that a fit takes at most; texts of more characters come after all others.
FIT_ROWS, FIT_CHARS = 1500, 20_000
ROUNDS, RATE, DECAY = 120, 0.5, 1e-4
OWN = 12  # features of a line by itself

_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_SIGN = np.array([33 <= b <= 126 and not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122) and b not in b".,;:'-" for b in range(256)])
_STOP = np.array([b in b".,;:" for b in range(256)])
_NOT_LINE_END = wv._table(b"\n")


@dataclass
class Lines:
    features: np.ndarray  # (lines, 3 * OWN + 1): own, before, after, constant
    first: np.ndarray  # lines of row i are first[i] to first[i + 1]
    weight: np.ndarray


def _sums(mask: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return (total[end] - total[begin]).astype(np.float64)


def lines_of(data: np.ndarray, offsets: np.ndarray) -> Lines:
    """Lines and features of texts. Blank lines are left out, unless a text has no other."""
    runs = wv.split(data, offsets, _NOT_LINE_END)
    count = np.diff(runs.first)
    # texts without lines get an empty one
    n = np.maximum(count, 1)
    first = np.concatenate([[0], np.cumsum(n)])
    begin, end = np.zeros(first[-1], np.int64), np.zeros(first[-1], np.int64)
    place = np.arange(len(runs.start)) + np.repeat(first[:-1] - runs.first[:-1], count)
    begin[place], end[place] = runs.start, runs.end
    size = np.maximum(end - begin, 1).astype(np.float64)

    words = wv.split(data, offsets)
    low = wv.hashes(data, words)
    w0, w1 = np.searchsorted(words.start, begin), np.searchsorted(words.start, end)
    n_words = np.maximum(w1 - w0, 1).astype(np.float64)
    same = np.zeros(len(low), bool)
    same[1:] = low[1:] == low[:-1]
    signed = np.zeros(len(low), bool)
    if len(low):  # words that end in a sign or an exclamation mark
        signed = _SIGN[data[words.end - 1]]
    alone = words.end - words.start == 1
    # words that came before in the same text: by their hash, first occurrences come first in a stable order
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))
    order = np.argsort(low + wv.mix64(row.astype(np.uint64)), kind="stable")
    again = np.zeros(len(low), bool)
    if len(low):
        again[order[1:]] = (low[order[1:]] == low[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    at = lambda mask: _sums(mask, w0, w1) / n_words
    per = lambda table: _sums(table[data], begin, end)
    letters = np.maximum(per(_LETTER), 1)
    own = np.stack(
        [
            per(_UPPER) / letters, per(_SIGN) / size, per(_DIGIT) / size, letters / size, at(same), at(again), at(signed), at(alone),
            np.minimum((size / n_words) / 10, 3), np.minimum(np.log1p(size) / 6, 2), per(_STOP) / n_words, (n_words < 3).astype(np.float64),
        ],
        axis=1,
    )
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first[:-1]], after[first[1:] - 1] = 0, 0
    return Lines(np.concatenate([own, before, after, np.ones((len(own), 1))], axis=1), first, size)


def _grid(first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chains of like length together: row numbers, and a (rows, longest) table of places, -1 past the end."""
    length = np.diff(first)
    order = np.argsort(length, kind="stable")
    at = 0
    while at < len(order):
        top = max(8, int(length[order[at]] * 1.5))
        stop = int(np.searchsorted(length[order], top, "right"))
        rows = order[at:stop]
        places = first[rows][:, None] + np.arange(length[rows].max())[None]
        yield rows, np.where(places < first[rows + 1][:, None], places, -1)
        at = stop


def marginals(score: np.ndarray, first: np.ndarray, stay: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance of state 1 at each line, and chances of the four steps into it from the line before
    (0 at first lines), for scores of state 1 over state 0 and step scores ``stay[from, to]``."""
    good, steps = np.zeros(len(score)), np.zeros((len(score), 4))
    step = np.exp(stay - stay.max())
    for _, place in _grid(first):
        here = place >= 0
        s = np.where(here, score[place], 0.0)
        emit = np.stack([1 / (1 + np.exp(np.clip(s, -30, 30))), 1 / (1 + np.exp(-np.clip(s, -30, 30)))], axis=2)
        n = place.shape[1]
        forward, back = np.zeros_like(emit), np.ones_like(emit)
        forward[:, 0] = emit[:, 0]
        forward[:, 0] /= forward[:, 0].sum(1, keepdims=True)
        for t in range(1, n):
            x = forward[:, t - 1] @ step * emit[:, t]
            forward[:, t] = np.where(here[:, t, None], x / x.sum(1, keepdims=True), forward[:, t - 1])
        for t in range(n - 2, -1, -1):
            x = (back[:, t + 1] * emit[:, t + 1]) @ step.T
            back[:, t] = np.where(here[:, t + 1, None], x / x.sum(1, keepdims=True), 1.0)
        both = forward * back
        good[place[here]] = (both[..., 1] / both.sum(2))[here]
        if n > 1:
            pair = forward[:, :-1, :, None] * step[None, None] * (emit * back)[:, 1:, None, :]
            pair = pair.reshape(*pair.shape[:2], 4)
            steps[place[:, 1:][here[:, 1:]]] = (pair / pair.sum(2, keepdims=True))[here[:, 1:]]
    return good, steps


@dataclass
class Field:
    weights: np.ndarray
    stay: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def line_chances(self, lines: Lines) -> np.ndarray:
        return marginals(lines.features @ self.weights, lines.first, self.stay)[0]

    def means(self, lines: Lines) -> np.ndarray:
        good = self.line_chances(lines)
        return np.add.reduceat(good * lines.weight, lines.first[:-1]) / np.add.reduceat(lines.weight, lines.first[:-1])

    def score(self, lines: Lines) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * _logit(self.means(lines)) + self.shift, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(texts: list[str], labels: list[int]) -> Field:
    """Maximum likelihood of the line labels, each document of the rarer label weighing more."""
    lines = lines_of(*wv.buffers(pa.array(texts, pa.string()))) if texts else lines_of(np.zeros(0, np.uint8), np.zeros(2, np.int64))
    field = Field(np.zeros(lines.features.shape[1]), np.zeros((2, 2)))
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        return Field(field.weights, field.stay, 0.0, 3.0 if labels and labels[0] else 0.0)
    of = np.repeat(np.arange(len(y)), np.diff(lines.first))
    target = y[of].astype(np.float64)
    balance = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())[of] / np.diff(lines.first)[of]
    began = np.zeros(len(of), bool)
    began[lines.first[:-1]] = True
    seen = np.zeros((len(of), 4))
    seen[np.arange(len(of)), np.where(target == 1, 3, 0)] = 1
    seen[began] = 0
    m = [np.zeros_like(field.weights), np.zeros(4)]
    v = [np.zeros_like(field.weights), np.zeros(4)]
    for k in range(1, ROUNDS + 1):  # Adam
        good, steps = marginals(lines.features @ field.weights, lines.first, field.stay)
        slopes = [lines.features.T @ (balance * (target - good)) - DECAY * field.weights, (balance[:, None] * (seen - steps)).sum(0) - DECAY * field.stay.ravel()]
        for i, g in enumerate(slopes):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
        move = [RATE * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-9) * (1 - k / (ROUNDS + 1)) for a, b in zip(m, v, strict=True)]
        field.weights += move[0]
        field.stay += move[1].reshape(2, 2)
    x = _logit(field.means(lines))
    share = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    a, b = 1.0, 0.0
    for _ in range(300):
        p = 1 / (1 + np.exp(-(a * x + b)))
        a += 0.5 * float((share * (y - p) * x).sum())
        b += 0.5 * float((share * (y - p)).sum())
    return Field(field.weights, field.stay, max(a, 0.05), b)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held_out: int = 0, rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> Field:
    """Fit on at most ``rows`` documents of either label."""
    ids = labelled_ids(docs, labels, label, crc_mod(F.col("doc_id"), folds) != held_out)
    sample, _ = fit_sample(ids, docs.select("doc_id", "text"), rows, chars)
    return fit([t for t, _ in sample], [y for _, y in sample])


def _score(batches: Iterator[pa.RecordBatch], field: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch in wv.slices(batches):
        lines = lines_of(*wv.buffers(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(field.value.score(lines))], ["doc_id", "held_out", "score"])


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    field = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    kind = docs.schema["doc_id"].dataType.simpleString()
    marked = docs.withColumn("held_out", crc_mod(F.col("doc_id"), 5) == 0)
    scored = marked.mapInArrow(partial(_score, field=field), f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))
