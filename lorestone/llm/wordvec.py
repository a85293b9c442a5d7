"""Words of Arrow string columns as numpy arrays: no Python object is made for a word.

Texts are handled in slices of a few MB, so temporary arrays stay small; a longer text is a slice
of its own. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _table(chars: bytes) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(chars)] = False
    return table


#: Bytes of words between blanks: all but space and tab to carriage return.
NOT_BLANK = _table(b" \t\n\x0b\x0c\r")
#: Bytes of words of digits, letters and all that is not ASCII.
ALNUM = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
#: Lower-cases A to Z alone.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * _ODD
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the offsets of the rows in them."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros(0)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, end - at)
            at = end


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    #: Words of row i are first[i] to first[i + 1].
    first: np.ndarray


def split(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = NOT_BLANK) -> Words:
    """Runs of ``inside`` bytes; no run goes over the end of a row."""
    mask = inside[data]
    begins, ends = mask.copy(), mask.copy()
    if len(mask):
        begins[1:] &= ~mask[:-1]
        ends[:-1] &= ~mask[1:]
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < len(mask))]
        begins[edge] = mask[edge]
        ends[edge - 1] = mask[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(start, end, np.searchsorted(start, offsets))


def hashes(data: np.ndarray, words: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes and length, by pieces of a long text."""
    if not len(words.start):
        return np.zeros(0, np.uint64)
    if len(data) <= 2 * SLICE_BYTES or len(words.start) == 1:
        low, high = int(words.start[0]), int(words.end[-1])
        return _hashes(data[low:high], words.start - low, words.end - low)
    parts, at = [], 0
    while at < len(words.start):
        low = int(words.start[at])
        end = max(at + 1, int(np.searchsorted(words.end, low + SLICE_BYTES, "right")))
        parts.append(_hashes(data[low : int(words.end[end - 1])], words.start[at:end] - low, words.end[at:end] - low))
        at = end
    return np.concatenate(parts)


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = len(data)
    powers = np.full(n, _BASE, np.uint64)
    powers[0] = 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * np.multiply.accumulate(powers), out=total[1:])
    back = np.full(n, _BASE_INVERSE, np.uint64)
    back[0] = 1
    raw = (total[end] - total[start]) * np.multiply.accumulate(back)[start]
    return mix64(raw + (end - start).astype(np.uint64) * _ODD)


def shingles(word_hash: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of k words of each row, sorted, and where each row's begin. A row of fewer
    words, but not none, has its whole sequence as its only shingle."""
    count = np.diff(first)
    n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    begin = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(begin[-1]) - begin[row] + first[row]
    size = np.minimum(count, k)[row]
    out = size.astype(np.uint64)
    for j in range(k):
        here = j < size
        out = np.where(here, (out ^ word_hash[np.where(here, at + j, at)]) * np.uint64(_BASE + 2 * j), out) if len(out) else out
        out = out ^ (out >> np.uint64(31))
    out = mix64(out)
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[begin[:-1][n > 0]] = True
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[begin]


def list_array(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
