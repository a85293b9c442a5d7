"""The pipeline's stages on a small corpus."""

from __future__ import annotations

import random
import re

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    say = lambda n: " ".join(f"{rng.choice('bcdfgh')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.randrange(40)}" for _ in range(n))
    passage = say(30)
    rows, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        rows.append((i, say(60) + (" wretch vermin" if bad else ""), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(bad)))
    rows += [(1000 + i, rows[1][1] + f" tail{i}", "en", "s0", 0) for i in range(10)]
    rows += [(2000 + i, f"{say(30)} {passage} {say(30)}", "en", "s1", 0) for i in range(6)] + [(3000, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    columns = spark.read.parquet(f"{tmp_path}/documents.parquet").columns
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    texts = {r.doc_id: r.text for r in docs.collect()}
    clean = [i for i in range(240) if i % 4]
    assert sum("wretch" in (t or "") for t in texts.values()) <= 2
    assert sum(i in texts for i in clean) >= len(clean) - 2
    assert not any(1000 <= i < 1010 for i in texts) and 1 in texts and 3000 in texts
    assert all(passage not in texts[2000 + i] and len(re.findall(r"\S+", texts[2000 + i])) == 60 for i in range(6))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"shard", "slot", *columns} == set(out.columns) and out.select("shard").distinct().count() == 8
