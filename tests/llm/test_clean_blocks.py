"""Cleaning doesn't depend on how many blocks the benchmark is taken in."""

from __future__ import annotations

import random

from lorestone.llm import decontaminate


def test_blocks_are_judged_and_cut_together(spark, monkeypatch):
    rng = random.Random(8)
    say = lambda n: " ".join(f"w{rng.randrange(100_000)}" for _ in range(n))
    items = [say(30) for _ in range(12)]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [f"{say(20)} {x} {say(20)} {y}" for x, y in zip(items, items[1:], strict=False)]  # each of two items covers 30 %
    for x, y in zip(items, items[1:], strict=False):
        half = y.split()
        texts.append(f"{say(60)} {' '.join(half[:8])} {x} {' '.join(half[8:16])} {say(60)}")  # y's window meets once x is gone
    texts += [f"{say(80)} {x}" for x in items] + [say(50), "", None]
    rows = [(i, t, len(t or "")) for i, t in enumerate(texts)] + [(0, texts[-4], 5), (None, texts[12], 7), (None, texts[12], 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = []
    for words in (decontaminate.BLOCK_WORDS, 60):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", words)
        got.append(sorted(map(repr, decontaminate.clean(docs, benchmark).collect())))
    left = {r.doc_id for r in decontaminate.clean(docs, benchmark).collect()}
    assert got[0] == got[1]
    assert not left & set(range(1, 11)) and set(range(11, len(texts))) <= left
