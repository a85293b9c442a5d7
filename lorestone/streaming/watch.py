"""Files that change, as a stream, and bursts of changes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lorestone.operators.incremental import Rule, watched
from lorestone.sources.files import relative

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def changes(spark: SparkSession, root: str, rules: Sequence[Rule]) -> DataFrame:
    """New files below ``root`` that the rules include, as a stream."""
    raw = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", True).load(root)
    files = raw.select(relative(F.col("path"), root).alias("path"), "content", F.col("modificationTime").alias("ts"))
    return files.filter(watched(F.col("path"), rules))


def watch(stream: DataFrame, index: Callable[[DataFrame], None], checkpoint: str, every: str = "2 seconds") -> StreamingQuery:
    """Index each burst. Bursts run one after the other; what changes meanwhile is in the next."""

    def run(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            index(batch)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def bursts(events: DataFrame, key: str, time: str = "ts", gap: str = "2 seconds", late: str = "10 minutes") -> DataFrame:
    """Changes of a key that follow each other within the gap, on a stream or a table."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("changes")).select(key, F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "changes")
