"""The source divergence audit against plain counting, with nulls, ties, repeats and clashing columns."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorestone.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"


def plainly(rows, least, most):
    """All rows of the audit, counted document by document in whole numbers."""
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    docs = [(g or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(t or ""))) for _, t, g, s in rows]
    df, of, groups = Counter(), defaultdict(Counter), defaultdict(set)
    for lang, source, words in docs:
        groups[lang].add(source)
        df.update((lang, w) for w in set(words))
        of[lang, source].update(words)
    out = set()
    for lang, sources in groups.items():
        kept = sorted(w for (g, w), n in df.items() if g == lang and n >= least)
        every = sum((of[lang, s] for s in sources), Counter())
        p = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for w in kept}  # noqa: B023, E731
        share, whole = {s: p(of[lang, s]) for s in sources}, p(every)
        for s in sources:
            pairs = [(sum(abs(share[s][w] - share[t][w]) for w in kept), t) for t in sources if t != s]
            terms = [(share[s][w] - whole[w], w) for w in kept if of[lang, s][w] and share[s][w] > whole[w]]
            for part, found, n in (("pair", pairs, len(pairs)), ("term", terms, most)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:n]
                out |= {(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)}
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["stone", "River", "étude", "gray", "ÉTUDE", "x", "日本", "a1b", "don't", "seven", "\U0001f600", "zebra"]
    out = [(i, " ".join(rng.choices(words, weights=range(1, 13), k=rng.choice([0, 1, 5, 40]))), rng.choice(["en", "fr", None, ""]), rng.choice(["a", "b", "c", None])) for i in range(150)]
    out += [(None, "nameless stone", "en", "a"), (200, None, "en", "d"), (201, "", "xx", "only"), (202, "12 34", "yy", "p"), (203, "rare", "yy", "q")]
    return out + [out[3], out[3], (300, "stone river " * 20_000 + "w" * 3_000_000, "en", "b")]


def got(df):
    return [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]


@pytest.mark.parametrize(("least", "most", "cells", "held"), [(3, 4, 1 << 19, 600_000), (3, 4, 2, 10), (1, 50, 7, 100)])
def test_against_plain_counting(spark, rows, least, most, cells, held, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "SLICE_BYTES", held * 10)
    monkeypatch.setattr(divergence, "CELLS", cells)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = got(divergence.divergence_report(docs, least, most))
    assert len(found) == len(set(found)) and set(found) == plainly(rows, least, most)


def test_empty_tables_and_clashing_columns(spark, rows):
    empty = divergence.divergence_report(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and dict(empty.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    more = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("own") for c in ("term", "n", "deal", "kept", "documents", "doc", "value")})
    assert set(got(divergence.divergence_report(more, 3, 4))) == plainly(rows, 3, 4)


def test_runs_go_over_batches():
    names = ["lang", "term", "source", "documents", "n"]
    keys = [("en", "a", "s")] * 5 + [("en", "b", "s")] * 2 + [("en", "b", None)] * 3 + [("fr", "b", None)]
    whole = pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in range(3)), pa.array([1] * 11), pa.array(range(11))], names)
    for step in (1, 2, 3, 11):
        found = [r for b in divergence._scan(whole.slice(a, step) for a in range(0, 11, step)) for r in b.to_pylist()]
        assert [(r["lang"], r["term"], r["source"], r["documents"], r["n"]) for r in found] == [("en", "a", "s", 5, 10), ("en", "b", "s", 2, 11), ("en", "b", None, 3, 24), ("fr", "b", None, 1, 10)]


def test_large_counts_stay_exact():
    import numpy as np

    counts, whole = np.array([[9 * 10**14, 0, 123456789012345]]), np.array([9 * 10**14 + 77, 10**15, 987654321098765])
    assert divergence.shares(counts, whole).tolist() == [[1 + 10**9 * int(c) // int(w) for c, w in zip(counts[0], whole, strict=True)]]
