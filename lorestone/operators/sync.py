"""Drift between two stores of the same documents, and what to do about it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plan(store: DataFrame, mirror: DataFrame) -> DataFrame:
    """``(id, action)``: upsert what the mirror lacks, delete what the store lacks."""
    missing = store.select("id").distinct().join(mirror.select("id"), "id", "left_anti").withColumn("action", F.lit("upsert"))
    return missing.unionByName(mirror.select("id").distinct().join(store.select("id"), "id", "left_anti").withColumn("action", F.lit("delete")))


def applied(store: DataFrame, mirror: DataFrame) -> DataFrame:
    """The mirror once the plan has been carried out; both have the same columns, ``id`` among them."""
    todo = plan(store, mirror)
    added = store.dropDuplicates(["id"]) if set(store.columns) == {"id"} else store
    added = added.join(todo.filter("action = 'upsert'").select("id"), "id", "left_semi")
    return mirror.join(todo.filter("action = 'delete'").select("id"), "id", "left_anti").unionByName(added)


def status(store: DataFrame, mirror: DataFrame | None) -> DataFrame:
    """One row: both counts and the drift; without a mirror all of the store has drifted."""
    have = store.agg(F.count_distinct("id").alias("store_count"))
    if mirror is None:
        return have.select("store_count", F.lit(0).cast("bigint").alias("mirror_count"), F.col("store_count").alias("drift"))
    return have.crossJoin(mirror.agg(F.count_distinct("id").alias("mirror_count"))).crossJoin(plan(store, mirror).agg(F.count("*").alias("drift")))


def three_way(shipped: DataFrame, installed: DataFrame, recorded: DataFrame, force: bool = False) -> DataFrame:
    """``(path, action)`` from hashes of the shipped, installed and recorded files ``(path, hash)``."""
    sides = [df.select("path", F.col("hash").alias(name)) for df, name in ((shipped, "shipped"), (installed, "installed"), (recorded, "recorded"))]
    both = sides[0].join(sides[1], "path", "full").join(sides[2], "path", "full")
    action = (
        F.when(F.col("shipped").isNull(), "leave")
        .when(F.col("installed").isNull(), "install")
        .when(F.col("installed") == F.col("shipped"), "same")
        .when(F.col("installed").eqNullSafe(F.col("recorded")) | F.lit(force), "update")
        .otherwise("skip")
    )
    return both.select("path", action.alias("action"))
