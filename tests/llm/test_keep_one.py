"""One row of each group of near-duplicates stays, whatever its ids are."""

from __future__ import annotations

import random
from collections import Counter

from lorestone.llm import neardup


def test_null_ids_and_repeated_rows_leave_one(spark):
    rng = random.Random(2)
    a, b, c, d, e = (" ".join(f"w{rng.randrange(10_000)}" for _ in range(60)) for _ in range(5))
    rows = [(None, a), (None, a), (None, a + " tail"), (None, b), (None, b), (7, c), (7, c), (7, c + " tail"), (9, c), (None, c), (3, d), (1, e), (1, d + " else"), (5, ""), (5, ""), (None, None), (None, "")]
    for given in (rows, list(reversed(rows))):
        docs = spark.createDataFrame(given, "doc_id long, text string")
        got = [(r.doc_id, r.text) for r in neardup.keep_one(docs, neardup.Setup(words=5, percent=80)).collect()]
        near = Counter(next((n for n, x in zip("abcde", (a, b, c, d, e), strict=True) if t and t.startswith(x)), "") for _, t in got)
        assert near == {"a": 1, "b": 1, "c": 1, "d": 1, "e": 1, "": 3}
        assert {i for i, t in got if t} == {None, 7, 1} and sum(i == 5 for i, _ in got) == 1
