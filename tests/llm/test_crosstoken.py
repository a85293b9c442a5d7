"""Cross-tokenizer alignment against whole-text encoding and a plain walk over both token lists."""

from __future__ import annotations

import hashlib
import os
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorestone.llm import crosstoken
from lorestone.llm import wordvec as wv

pytestmark = pytest.mark.skipif(not Path(crosstoken.FOLDER, crosstoken.FIRST).exists(), reason="the tokenizers are not here")
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def plain():
    """Ids of both sides of whole texts, by each library's own reading of its file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(f"{crosstoken.FOLDER}/{crosstoken.FIRST}"), SentencePieceProcessor(model_file=f"{crosstoken.FOLDER}/{crosstoken.SECOND}")
    first.encode_special_tokens = True
    return lambda t: (first.encode(" " + t, add_special_tokens=False).ids, second.encode(t))


def both_bytes():
    return crosstoken.first_bytes(f"{crosstoken.FOLDER}/{crosstoken.FIRST}"), crosstoken.second_bytes(f"{crosstoken.FOLDER}/{crosstoken.SECOND}")


def plainly(rows, plain):
    of, found = both_bytes(), []
    for doc_id, text in rows:
        sides = plain(text) if text else ([], [])
        if any(b"".join(b[i] for i in ids) != f" {text}".encode() for b, ids in zip(of, sides, strict=True)) or not text:
            sides = ([], [])
        at = [dict(zip(np.cumsum([len(b[i]) for i in ids]).tolist(), ids, strict=True)) for b, ids in zip(of, sides, strict=True)]
        cuts = sorted(set(at[0]) & set(at[1]))
        parts = [[[] for _ in cuts] for _ in at]
        for side, part in zip(at, parts, strict=True):
            k = 0
            for e, i in side.items():
                part[k].append(str(i))
                k += e == cuts[k]
        groups = ["|".join(map(",".join, g)) for g in zip(*parts, strict=True)]
        found.append((doc_id, sides, [(at[0][c], at[1][c]) for c in cuts], hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    counts = Counter(p for *_, links, _ in found for p in links)
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return sorted(repr((d, len(a), len(b), len(links), len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links), said)) for d, (a, b), links, said in found)


def said(df):
    return sorted(repr(tuple(r)) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


PIECES = ["the", "Stone's", "étude", "don't", "日本語", "naïve", "ß", "é", "x y", "a b", "́", "12345", "$%&", "<|endoftext|>", "<s>", "<0x0A>", "\U0001f600", "fiﬁ", "аб", "ab\tc", "\x00", " ", "\u0085"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    gaps = [" ", " ", " ", "  ", "\n", "\t ", " \n ", "   ", ""]
    out = [(i, "".join(rng.choice(PIECES) + rng.choice(gaps) for _ in range(rng.choice([1, 2, 10, 60])))) for i in range(150)]
    out += [(200, None), (201, ""), (202, " "), (203, "   "), (204, " a"), (205, "a "), (206, "a  b"), (207, "\n"), (208, "x ▁y"), (209, "▁"), (210, "é é à ü"), (None, "nameless one"), (None, None)]
    return out + [out[3], out[3], (300, "lantern quiet " * 20_000 + "harbour" * 500)]


def test_words_are_encoded_as_in_whole_texts(rows, plain):
    texts = [t for _, t in rows]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts, pa.string())], ["uid", "doc_id", "text"])
    paths = [f"{crosstoken.FOLDER}/{n}" for n in (crosstoken.FIRST, crosstoken.SECOND)]
    (out,) = crosstoken._tokens(iter([batch]), *paths)
    for text, row in zip(texts, out.column("text").to_pylist(), strict=True):
        a, b = plain(text) if text else ([], [])
        spelt = all(b"".join(of[i] for i in ids) == f" {text}".encode() for of, ids in zip(both_bytes(), (a, b), strict=True))
        assert tuple([i + crosstoken.HALF for i in row[side]] for side in "ab") == ((a, b) if text and spelt else ([], [])), repr(text)
    words, at = crosstoken._cut(*wv.buffers(pa.array(["one two  three", None, "é ü", " x "])))
    assert words.to_pylist() == ["one", "two  three", "é", "ü", " x "] and at.tolist() == [0, 2, 2, 4, 5]


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_alignment(spark, rows, plain, most):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("own") for c in ("uid", "end", "links", "grp", "length")})
    assert said(crosstoken.align_report(docs, most=most)) == plainly(rows, plain)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_other_ids_and_empty_tables(spark):
    assert {(r.doc_id, r.n_groups > 0) for r in crosstoken.align_report(spark.createDataFrame([("a", "word"), ("b", None)], "doc_id string, text string")).collect()} == {("a", True), ("b", False)}
    assert crosstoken.align_report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_groups_are_written_by_batches(spark, rows, plain, monkeypatch):
    """Windows add up lengths only, a slice of few tokens ends inside a table, and a document may be longer than a slice."""
    plans, written = [], crosstoken.materialize
    monkeypatch.setattr(crosstoken, "materialize", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or written(df))
    monkeypatch.setattr(crosstoken, "SAID_TOKENS", 40)
    docs = spark.createDataFrame(rows[:40], SCHEMA)
    assert said(crosstoken.align_report(docs)) == plainly(rows[:40], plain)
    assert plans[0].count("Window [") == 2 and plans[0].count("Join Inner") == 3
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8]), pa.array([{"doc_id": d, "a": x, "b": x} for d, x in ((1, [1 - crosstoken.HALF] * 90), (2, []))], pa.struct([("doc_id", pa.int64()), ("a", pa.list_(pa.int16())), ("b", pa.list_(pa.int16()))])), pa.array([[k << 32 | k for k in range(1, 90, 2)], None], pa.list_(pa.int64()))], ["uid", "text", "cuts"])
    found = [r for part in crosstoken._grouped(iter([batch])) for r in part.to_pylist()]
    assert [(r["uid"], r["n_groups"], len(r["links"]), r["groups_sha256"]) for r in found] == [(7, 45, 45, hashlib.sha256(";".join(["1,1|1,1"] * 45).encode()).hexdigest()), (8, 0, 0, "")]


@pytest.mark.parametrize("remembered", [400_000, 3])
def test_words_met_in_an_earlier_slice_are_not_encoded_again(plain, monkeypatch, remembered):
    monkeypatch.setattr(crosstoken, "REMEMBERED", remembered)
    encoder = crosstoken._Encoder(*(f"{crosstoken.FOLDER}/{n}" for n in (crosstoken.FIRST, crosstoken.SECOND)))
    encoded, inner = [], encoder._encoded
    monkeypatch.setattr(encoder, "_encoded", lambda words: encoded.extend(words.to_pylist()) or inner(words))
    for words in (["stone", " x", "étude", "x▁", "harbour"], ["harbour", "日本", "stone", "a  b", " x", "x▁"], ["stone", "日本"], []):
        sides, spelt = encoder.words(pa.array(words, pa.large_string()))
        for k, word in enumerate(words):
            ids = [side.of(np.array([k])).ids.tolist() for side in sides]
            assert ids == [list(i) for i in plain(word)]
            assert spelt[k] == all(b"".join(of[i] for i in x) == f" {word}".encode() for of, x in zip(both_bytes(), ids, strict=True))
    assert len(encoded) == len(set(encoded)) == 7 and not spelt.size
