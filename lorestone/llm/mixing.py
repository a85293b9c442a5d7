"""Mixing sources to target weights.

Sizes are summed per source, a water level turns weights into targets, and each document is
emitted ``floor(rate)`` times plus one hash-seeded Bernoulli copy with the rate's fraction.

Defined results: a null text has size 0; null sources form one source; a source of size 0 has
target 0 and keeps no copies; repeated rows are separate documents that share their id's draw;
an empty table gives an empty mix. Further columns of the input pass through ``emit``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorestone.llm.common import bounded, materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Hexadecimal digits of the digest that make the draw; 13 digits fit a double's mantissa.
DIGITS = 13


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) that depends on the seed and the id only (without an id, on the text)."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(key), 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def cycle_weights(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Give the sources, by code point and null last, the weights in turn. One row per source."""
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long"))


def targets(sized: DataFrame, share: float = 1.5, cap: int = 2) -> DataFrame:
    """Targets of ``sized(source, source_size, weight)``: one row per source, so the windows are small.

    All targets add up to ``share`` of all sizes, in proportion to the weights, and none exceeds
    ``cap`` times its source's size. With the sources by cap per weight, the water level is the
    largest of the levels that follow from assuming that just the earlier ones are full.
    """
    everything = W.partitionBy(F.lit(1))
    order = everything.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    top = sized.withColumn("ratio", F.col("source_size") * cap / F.col("weight"))
    top = top.withColumn("left", F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0)))
    top = top.withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    top = top.withColumn("level", F.max(F.col("left") / F.col("open")).over(everything))
    target = F.least((F.col("source_size") * cap).cast("double"), F.col("level") * F.col("weight"))
    return top.select("source", "source_size", target.alias("target"))


def plan(sized_docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: int = 2) -> DataFrame:
    """Targets of every source of ``sized_docs(source, size)``; the sums combine before they shuffle."""
    by_source = sized_docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    return materialize(targets(cycle_weights(by_source, weights), share, cap))


def with_copies(docs: DataFrame, goals: DataFrame, size: Column, u: Column) -> DataFrame:
    """``docs`` with ``__size``, ``__source_size``, ``__target`` and ``__copies``, which must be new."""
    goals = goals.select(F.col("source").alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    return (
        docs.withColumns({"__size": size, "__u": u})
        .join(bounded(goals), F.col("source").eqNullSafe(F.col("__source")), "left")
        .withColumn("__copies", (whole + F.when(F.col("__u") < rate - whole, 1).otherwise(0)).cast("int"))
    )


def mix_report(docs: DataFrame) -> DataFrame:
    """Per document: its size, its source's size and target, and the words that the mix takes."""
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), draw(F.col("doc_id"), F.col("text")).alias("u")))
    out = with_copies(sized, plan(sized), F.col("size"), F.col("u"))
    return out.select("doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("size") * F.col("__copies")).alias("taken"))


def emit(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: int = 2) -> DataFrame:
    """The mixed documents: every row as often as the mix takes it, with the columns of ``docs``, whatever they are called."""
    size = word_count(F.col("text"))
    goals = plan(docs.select("source", size.alias("size")), weights, share, cap)
    # the row travels as one struct, so no name of its columns can clash
    row = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "source")
    out = with_copies(row, goals, size, draw(F.col("doc_id"), F.col("text"))).filter("__copies > 0")
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("row.*")


OP1_SQL = """
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
    ('0x' || substr(md5('mix:' || coalesce(cast(doc_id as varchar), 'null:' || coalesce(text, ''))), 1, 13))::bigint::double
      / 4503599627370496.0 as u
  from documents),
by_source as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (
  select *, [3, 1, 2][1 + ((row_number() over (order by source asc nulls last) - 1) % 3)::int] as weight from by_source),
ratio as (select *, source_size * 2 / weight as ratio from weighed),
filled as (
  select *, 1.5::double * sum(source_size) over ()
      - coalesce(sum(source_size * 2) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0) as space,
    sum(weight) over () - coalesce(sum(weight) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0) as open_weight
  from ratio),
goals as (
  select source, source_size, least((source_size * 2)::double, max(space / open_weight) over () * weight) as target from filled),
rated as (
  select s.doc_id, s.size, g.source_size, g.target, s.u,
    case when g.source_size > 0 then g.target / g.source_size else 0.0 end as rate
  from sized s join goals g on s.source is not distinct from g.source)
select doc_id, size, source_size, target,
  (size * (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end))::bigint as taken
from rated
"""
