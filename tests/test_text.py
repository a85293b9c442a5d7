"""Text functions against models in Python."""

from __future__ import annotations

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorestone.functions import text as tx

TEXT = st.text(alphabet="abc é.!?\n ", max_size=120)


SOLID = lambda t: re.sub(r"\s", "", t)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(TEXT, min_size=20, max_size=40))
def test_resplit_keeps_all_and_stays_within_the_budget(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: (r.parts, r.words) for r in df.select("i", tx.resplit(F.col("t"), 5).alias("parts"), tx.word_count(F.col("t")).alias("words")).collect()}
    for i, t in enumerate(texts):
        parts, words = got[i]
        assert words == len(t.split()) and SOLID("".join(parts)) == SOLID(t)  # only blanks between pieces go
        assert all(len(p) < 4 * 6 for p in parts)  # five tokens of four characters, and a part of one
        if len(t) < 4 * 6:
            assert parts == [t]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.text(alphabet="abc", max_size=30), min_size=1, max_size=12), min_size=20, max_size=30))
def test_merged_neighbours_fit_and_no_two_could_join(spark, lists):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<string>")
    tokens = lambda s: len(s) // 4
    for r in df.select("x", tx.greedy_merge(F.col("x"), "|", 5).alias("pieces")).collect():
        split = [p.split("|") for p in r.pieces]
        assert [q for p in split for q in p] == r.x
        assert all(len(p) == 1 or sum(map(tokens, p)) <= 5 for p in split)
        assert all(sum(map(tokens, a)) + tokens(b[0]) > 5 for a, b in zip(split, split[1:]))


def test_small_functions(spark):
    one = spark.range(1)
    row = one.select(
        tx.duration_ms(F.lit("3d")).alias("d"), tx.module_name(F.lit("a/b/__init__.py")).alias("m"), tx.module_name(F.lit("a/b.py")).alias("n"), tx.last_component(F.lit("a.b.C")).alias("c"),
        tx.breadcrumb(F.array(F.lit("A")), F.lit("B")).alias("ab"), tx.breadcrumb(F.array(F.lit("A")), F.lit("A")).alias("a"), tx.breadcrumb(F.array().cast("array<string>"), F.lit(None).cast("string")).alias("none"),
        tx.content_type(F.lit("| a | b |\n```x```")).alias("mixed"), tx.comma_list(F.lit(" a, ,b ")).alias("list"), tx.ellipsis(F.lit("abcdef"), 4).alias("e"),
    ).first()
    assert (row.d, row.m, row.n, row.c, row.ab, row.a, row.none, row.mixed, row.list, row.e) == (259_200_000, "a.b", "a.b", "C", "A > B", "A", "Document", "mixed", ["a", "b"], "abc…")


def test_globs():
    full = lambda g, p: bool(re.match(tx.glob_pattern(g), p))
    assert full("docs/**/*.md", "docs/a.md") and full("docs/**/*.md", "docs/x/y/a.md")
    assert not full("docs/*.md", "docs/x/a.md") and not full("docs/*.md", "docs/axmd")
