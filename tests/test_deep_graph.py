"""Descendants go as deep as the graph does."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorestone.operators import graph


def test_descendants_have_no_bound(spark):
    nodes = spark.range(20).select(F.col("id").cast("string").alias("id"))
    edges = spark.range(20).select(F.col("id").cast("string").alias("from_id"), (F.col("id") + 1).cast("string").alias("to_id"), F.lit("CONTAINS").alias("rel_type"))
    edges = edges.union(spark.createDataFrame([("19", "0", "CONTAINS")], edges.schema))  # a ring ends too
    assert graph.descendants(nodes, edges, F.col("id") == "0").count() == 20
    assert graph.descendants(nodes, edges, F.col("id") == "0", depth=2).count() == 3
