"""Many queries at once, and many peers at once."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorestone.operators import federation, search


@pytest.mark.parametrize(("n", "m", "k", "block"), [(300, 130, 7, 64), (5, 9, 10, 2048), (64, 64, 1, 16)])
def test_nearest_of_each(spark, n, m, k, block, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", block)
    rng = np.random.default_rng(4)
    c, q = rng.integers(-3, 4, (n, 6)) / 2 + 1000, rng.integers(-3, 4, (m, 6)) / 2 + 1000  # many ties, far from zero
    chunks = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(c)] + [(-1, None, "x")], "cid int, vector array<float>, query_id string").repartition(3)
    queries = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(q)] + [("none", None)], "query_id string, query_vector array<float>").repartition(4)
    got = {(r.query_id, r.place): (r.cid, r.distance) for r in search.top_k_each(queries, chunks, "cid", k).collect()}
    want = {}
    for i, v in enumerate(q):
        ranked = sorted((round(float(((v - w) ** 2).sum()), 6), j) for j, w in enumerate(c))[:k]
        want |= {(f"q{i}", p): (j, d) for p, (d, j) in enumerate(ranked, 1)}
    assert got == want
    assert search.top_k_each(queries.limit(0), chunks, "cid", k).count() == 0 and search.top_k_each(queries, chunks.limit(0), "cid", k).count() == 0


def test_peers_that_hang_or_are_damaged(spark, tmp_path):
    def store(name, scores):
        spark.createDataFrame([(f"{name}{i}", s) for i, s in enumerate(scores)], "chunk string, score double").write.parquet(str(tmp_path / name))
        return lambda s: s.read.parquet(str(tmp_path / name)).orderBy(F.desc("score")).limit(2)

    def hangs(s):
        def wait(batches):
            time.sleep(60)
            yield from batches

        return s.range(0, 1, 1, 1).mapInPandas(wait, "id long").selectExpr("'x' as chunk", "1.0d as score")

    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_bytes(b"damaged")
    peers = {"a": store("a", [0.5, 0.9, 0.1]), "slow": hangs, "b": store("b", [0.7]), "bad": lambda s: s.read.schema("chunk string, score double").parquet(str(tmp_path / "bad")), "gone": lambda s: s.read.parquet(str(tmp_path / "gone"))}
    began = time.time()
    out = federation.fan_out(spark, peers, 8.0)
    assert [(r.server, r.chunk) for r in out.hits.collect()] == [("a", "a1"), ("b", "b0"), ("a", "a0")] and time.time() - began < 40
    assert out.unreachable == ("slow", "bad", "gone") and federation.fan_out(spark, {"gone": peers["gone"]}).hits is None
