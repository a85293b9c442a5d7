"""Documents and sections put together from chunks, and the chunks' structure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def joined(order: str, content: str, separator: str = "\n\n") -> Column:
    """Contents of a group in order, as one text."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, content))), lambda x: x[content]), separator)


def list_documents(chunks: DataFrame, document: str, order: str, first: Sequence[str]) -> DataFrame:
    """A row a document: its number of chunks, and columns of its first chunk."""
    return chunks.groupBy(document).agg(F.count("*").alias("chunk_count"), *[F.min_by(c, order).alias(c) for c in first])


def get_document(chunks: DataFrame, document: str, order: str, content: str, only: Column | None = None, first: Sequence[str] = ()) -> DataFrame:
    """Documents, or the sections that ``only`` selects, with their text and columns of their first chunk."""
    rows = chunks if only is None else chunks.filter(only)
    return rows.groupBy(document).agg(joined(order, content).alias("content"), F.count("*").alias("chunk_count"), *[F.min_by(c, order).alias(c) for c in first])


def _so_far(document: str, order: str) -> W:
    return W.partitionBy(document).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)


def with_parent(chunks: DataFrame, document: str, order: str, level: str, chunk_id: str) -> DataFrame:
    """Chunks of level 3 get the id of the last level-2 chunk before them."""
    last = F.last(F.when(F.col(level) == 2, F.col(chunk_id)), ignorenulls=True).over(_so_far(document, order))
    return chunks.withColumn("parent_chunk_id", F.when(F.col(level) == 3, last))


def merge_level_3(chunks: DataFrame, document: str, order: str, level: str, content: str) -> DataFrame:
    """Chunks of level 3 join the last chunk of a level above; those before any stay as they are."""
    group = F.sum(F.when(F.col(level) <= 2, 1).otherwise(0)).over(_so_far(document, order))
    own = F.when(group == 0, -F.row_number().over(W.partitionBy(document).orderBy(order))).otherwise(group)
    rows = chunks.withColumn("group", own)
    return rows.groupBy(document, "group").agg(F.min(order).alias(order), F.min_by(level, order).alias(level), joined(order, content).alias(content)).drop("group")


def section_parent(chunks: DataFrame, document: str, order: str, level: str, key: str, levels: int = 3) -> DataFrame:
    """The last earlier chunk of a smaller level, unless one of a level still smaller came after it."""
    before = W.partitionBy(document).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    lasts = [F.last(F.when(F.col(level) == n, F.struct(F.col(order).alias("at"), F.col(key).alias("key"))), ignorenulls=True).over(before) for n in range(1, levels)]
    rows = chunks.withColumns({f"last_{n}": c for n, c in enumerate(lasts, 1)})
    found = F.greatest(*[F.when(F.col(level) > n, F.col(f"last_{n}")) for n in range(1, levels)], F.lit(None).cast(rows.schema["last_1"].dataType))
    return rows.withColumn("parent", found["key"]).drop(*[f"last_{n}" for n in range(1, levels)])
