"""Rules by the thousand: those of a table against plain patterns, and a list with many of them for one folder."""

from __future__ import annotations

import random
import re
import time

from pyspark.sql import functions as F

from lorestone.functions.text import glob_pattern
from lorestone.operators.incremental import Rule
from lorestone.sources.rules import Trie, assign_of_table


def slowly(path, rules):
    hit = [r for r in rules if re.search(glob_pattern(r.glob), path, re.DOTALL)]
    return None if any(r.exclude for r in hit) else next((r.name for r in hit), None)


def test_rules_of_a_table_agree_with_patterns(spark):
    rng = random.Random(5)
    parts = ["a", "b", "c.md", "*", "**", "*.md", "a*", "?", "**b", "a**", "a**c", "x.y", "x?y", "**.md", "****", "***", "ä*", "(+"]
    rules = [Rule(f"r{k}", "/".join(rng.choice(parts) for _ in range(rng.choice([1, 2, 3, 4]))), rng.random() < 0.08) for k in range(90)]
    names = ["a", "b", "c.md", "d.md", "ab", "ac", "x.y", "xzy", "ä1", "(+", "a\nb"]
    paths = sorted({"/".join(rng.choice(names) for _ in range(rng.choice([1, 2, 3, 4, 5]))) for _ in range(500)} | {""})
    table = spark.createDataFrame([(p, 1) for p in paths] + [(None, 2), (paths[5], 3)], "path string, rule int").withColumn("more", F.lit("x"))
    for chosen in ([r for r in rules if not r.exclude], rules, rules[:7], [r for r in rules if r.exclude], []):
        known = spark.createDataFrame([(k, r.name, r.glob, r.exclude) for k, r in enumerate(chosen)], "place long, name string, glob string, exclude boolean").repartition(3)
        got = assign_of_table(table, known)
        want = {p: slowly(p, chosen) for p in paths if slowly(p, chosen)}
        rows = got.collect()
        assert set(got.columns) == {"path", "more", "rule"} and {r.path: r.rule for r in rows} == want
        assert len(rows) == len(want) + (paths[5] in want)


def test_many_rules_for_one_folder():
    began = time.time()
    trie = Trie([Rule(f"r{k}", f"d/f{k}.*") for k in range(24_000)])
    assert time.time() - began < 20  # 47 seconds when each was compared with all before it
    assert trie.of("d/f23999.md", {}) == "r23999" and trie.of("d/g", {}) is None
