"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A table goes to every executor only if it was counted and has no more rows than this.
BROADCAST_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder in the cluster's shared ``spark.checkpoint.dir``.

    Only where that setting is absent and Spark runs on this machine alone, as in tests, a temporary
    folder is named in it first. A cluster without the setting is an error, as its executors share no other folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="lorestone-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/lorestone-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts lineage: a lost executor costs the readers one task's rows, not the whole history.
    """
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``small``, hinted for broadcast only if a count shows that it has at most ``rows`` rows."""
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small


def id_text(doc_id: Column) -> Column:
    """The id as text; a null id counts as the empty string."""
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def crc_mod(doc_id: Column, n: int) -> Column:
    return F.crc32(id_text(doc_id)) % F.lit(n)


def unused(columns: list[str], name: str) -> str:
    """``name``, with underscores before it until no column is called that, in either case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def labelled_ids(docs: DataFrame, labels: DataFrame, label: str, learnable: Column) -> DataFrame:
    """``(doc_id, y, size)`` of the learnable documents that ``label`` marks 0 or 1. Lengths meet the labels, never texts."""
    known = labels.filter(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y")).distinct()
    return docs.filter(learnable & F.col("text").isNotNull()).select("doc_id", F.length("text").alias("size")).join(known, "doc_id")


def fit_sample(ids: DataFrame, texts: DataFrame, rows: int, chars: int) -> tuple[list[tuple[str, object]], DataFrame]:
    """The rows of ``sample_table``, on the driver, and the table that they come from."""
    sample, ids = sample_table(ids, texts, rows, chars)
    return [(r["text"], r["y"]) for r in sample.orderBy("doc_id", "y").select("text", "y").collect()] if sample else [], ids


def sample_table(ids: DataFrame, texts: DataFrame, rows: int, chars: int) -> tuple[DataFrame | None, DataFrame]:
    """A bounded sample ``(doc_id, y, text)`` of ``texts(doc_id, text)``, which may also have ``y``, to fit a model on, or None
    if it is empty; and the table of all ``ids(doc_id, y, size)`` that it comes from.

    Of each label the ``rows`` texts with the least draws by their ids, those of at most ``chars`` characters
    first. Longer ones fill up a label that has fewer, as long as the label's texts stay within rows * chars
    characters together; one that alone is longer is left out. Two passes read the texts: one for ids and lengths,
    one for the sample. Of texts that share an id and a label the least is taken. Rows without id, text or label are
    left out.
    """
    digest = F.sha2(F.col("doc_id").cast("string"), 256)
    draw = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    known = F.col("doc_id").isNotNull() & F.col("size").isNotNull() & F.col("y").isNotNull()
    ids = materialize(ids.filter(known).select("doc_id", "y", "size", draw.alias("draw")))
    once = ids.groupBy("doc_id", "y", "draw").agg(F.min("size").alias("size")).withColumn("long", F.col("size") > chars)
    counts = once.groupBy("y", "long").count().collect()
    chosen: list[tuple] = []
    for times in (4, 64, None):  # only low draws are ranked; all of them should these ever be too few
        most = [(r["y"], r["long"], min(1.0, (times * rows + 100) / r["count"]) if times else 1.0) for r in counts]
        if not most:
            break
        limits = once.sparkSession.createDataFrame(most, once.select("y", "long", "draw").schema).withColumnRenamed("draw", "most")
        near = once.join(F.broadcast(limits), ["y", "long"]).filter(F.col("draw") <= F.col("most"))
        place = F.row_number().over(W.partitionBy("y", "long").orderBy("draw", "doc_id"))
        ranked = near.withColumn("place", place).filter(F.col("place") <= rows).orderBy("y", "long", "place").collect()
        found = {(r["y"], r["long"]): r["place"] for r in ranked}
        if all(found.get((r["y"], r["long"]), 0) >= min(rows, r["count"]) for r in counts):
            break
    taken: dict[object, list[int]] = {}
    for r in ranked if counts else []:
        number, space = taken.setdefault(r["y"], [0, rows * chars])
        if number < rows and r["size"] <= space:
            taken[r["y"]] = [number + 1, space - r["size"]]
            chosen.append((r["doc_id"], r["y"]))
    if not chosen:
        return None, ids
    # at most `rows` ids of each label
    kept = F.broadcast(ids.sparkSession.createDataFrame(chosen, ids.select("doc_id", "y").schema))
    both = texts.filter(F.col("text").isNotNull()).join(kept, ["doc_id", "y"] if "y" in texts.columns else "doc_id")
    least = both.groupBy("doc_id", "y").agg(F.min(F.struct(F.length("text"), "text")).alias("x"))
    return least.select("doc_id", "y", "x.text"), ids


def values(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A table of numbers that the driver holds already, hinted for broadcast if it is short."""
    columns = names.split()
    if len(rows) > BROADCAST_ROWS:
        return spark.createDataFrame(rows, columns)
    cell = lambda v: f"{v!r}D" if isinstance(v, float) else f"{v}L"
    listed = ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)
    return F.broadcast(spark.sql(f"select * from values {listed} as t({', '.join(columns)})"))
