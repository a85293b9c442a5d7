"""Markdown files as sections, by Spark: lines with a running count of fences, headings by windows, sections by grouping."""

from __future__ import annotations

import json

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Number signs that tell headings apart; more count like so many.
LEVELS = 9
_HEADER = r"(?sd)^---\s*\n(.*?)\n---\s*(?:\n|$)"


def _header(text: pd.Series) -> pd.DataFrame:
    """A header's fields as JSON, or the name of what is wrong with it."""

    def one(t: str | None) -> tuple[str | None, str | None]:
        if t is None:
            return None, None
        try:
            return json.dumps(yaml.safe_load(t), default=str), None
        except Exception as e:  # noqa: BLE001  a header that isn't YAML is text
            return None, type(e).__name__

    return pd.DataFrame([one(t) for t in text], columns=["front", "error"])


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def sections(files: DataFrame) -> DataFrame:
    """``(path, section, stack, content)`` of ``files(path, body)``: numbered sections with the titles of the headings they are under, their
    own last. A line in a fence is no heading; what comes before the first heading has no titles."""
    order = W.partitionBy("path").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = files.select("path", F.posexplode(F.split("body", "\n")).alias("pos", "line"))
    rows = rows.withColumn("fenced", F.sum(F.col("line").rlike(r"(?U)^\s*```").cast("int")).over(order) % 2 == 1)
    mark = F.when(~F.col("fenced"), F.nullif(F.length(F.regexp_extract("line", r"(?dU)^(#+)\s(.*)$", 1)), F.lit(0)))
    rows = rows.withColumn("depth", F.when(mark.isNotNull(), F.least(mark, F.lit(LEVELS))))
    rows = rows.withColumn("section", F.count("depth").over(order))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    title = F.max(F.when(F.col("depth").isNotNull(), _stripped(F.regexp_extract("line", r"(?dU)^(#+)\s(.*)$", 2))))
    found = rows.groupBy("path", "section").agg(F.max("depth").alias("depth"), title.alias("title"), _stripped(lines).alias("content"))
    # the last heading of each depth so far; one is above this section if no heading of its depth or less came after it
    until = W.partitionBy("path").orderBy("section").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = [F.last(F.when(F.col("depth") == k, F.struct("section", "title")), ignorenulls=True).over(until) for k in range(1, LEVELS + 1)]
    found = found.withColumn("last", F.array(*last))
    above = F.filter("last", lambda x, i: x.isNotNull() & (i < F.col("depth")) & ~F.exists(F.slice("last", 1, i), lambda y: y.isNotNull() & (y["section"] > x["section"])))
    stack = F.coalesce(F.transform(above, lambda x: x["title"]), F.array().cast("array<string>"))
    return found.filter("content <> ''").select("path", "section", stack.alias("stack"), "content")


def merged(found: DataFrame) -> DataFrame:
    """Sections of the third depth and below joined to the one above."""
    deep = (F.size("stack") >= 3) & (F.row_number().over(W.partitionBy("path").orderBy("section")) > 1)
    rows = found.withColumn("head", ~deep).withColumn("grp", F.sum(F.col("head").cast("int")).over(W.partitionBy("path").orderBy("section")))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "content"))), lambda x: x["content"]), "\n\n")
    return rows.groupBy("path", "grp").agg(F.min("section").alias("section"), F.min_by("stack", "section").alias("stack"), texts.alias("content")).drop("grp")


def parse(files: DataFrame, kb: str, split_h2: bool = False) -> DataFrame:
    """``(path, document, chunks, nodes, edges)`` of ``files(path, content)``; equal paths are one file."""
    text = F.coalesce(F.expr("make_valid_utf8(cast(content as string))"), F.lit(""))
    heads = files.select("path", text.alias("text")).withColumn("head", F.nullif(F.regexp_extract("text", _HEADER, 0), F.lit("")))
    heads = heads.withColumn("read", F.pandas_udf(_header, "struct<front:string,error:string>")(F.when(F.col("head").isNotNull(), F.regexp_extract("text", _HEADER, 1))))
    heads = heads.withColumn("body", F.when(F.col("head").isNotNull() & F.col("read.error").isNull(), F.expr("substring(text, length(head) + 1)")).otherwise(F.col("text")))
    found = sections(heads.select("path", "body"))
    found = merged(found) if split_h2 else found
    doc = F.concat(F.lit(f"{kb}::"), F.col("path"))
    crumb = lambda stack: F.coalesce(F.nullif(F.array_join(stack, " > "), F.lit("")), F.lit("Document"))
    parent = F.nullif(F.array_join(F.slice("stack", 1, F.greatest(F.size("stack") - 1, F.lit(0))), " > "), F.lit(""))
    above = F.coalesce(F.concat(doc, F.lit("::"), parent), doc)
    found = found.withColumn("crumb", crumb(F.col("stack"))).withColumn("id", F.concat(doc, F.lit("::"), F.col("crumb"))).withColumn("above", above)
    found = found.withColumn("first", F.row_number().over(W.partitionBy("path", "crumb").orderBy("section")) == 1)
    name = F.element_at(F.split("crumb", " > "), -1)
    row = F.struct(
        "section", "crumb", "content", F.greatest(F.least(F.size("stack"), F.lit(3)), F.lit(1)).alias("level"), "id", "first", "above",
        F.create_map(F.lit("name"), name, F.lit("breadcrumb"), F.col("crumb")).alias("properties"),
    )
    rows = found.groupBy("path").agg(F.collect_list(row).alias("rows"))
    one = heads.groupBy("path").agg(F.first("read").alias("read")).join(rows, "path", "left")
    listed = F.array_sort(F.transform(F.coalesce("rows", F.array().cast(rows.schema["rows"].dataType)), lambda x: x.dropFields("properties")))
    held = F.map_from_entries(F.transform(F.coalesce("rows", F.array().cast(rows.schema["rows"].dataType)), lambda x: F.struct(x["section"], x["properties"])))
    one = one.withColumns({"listed": listed, "held": held})
    new = F.filter("listed", lambda x: x["first"])
    error = F.when(F.col("read.error").isNotNull(), F.create_map(F.lit("frontmatter_error"), F.col("read.error"))).otherwise(F.create_map().cast("map<string,string>"))
    about = F.map_concat(F.create_map(F.lit("relative_path"), F.col("path"), F.lit("language"), F.lit("markdown")), error)
    chunk = lambda x, i: F.struct(
        x["crumb"].alias("header_breadcrumb"), x["content"].alias("content"), x["level"].alias("chunk_level"), i.alias("chunk_index"), F.lit("markdown_section").alias("kind"), F.lit("markdown").alias("language"),
        x["id"].alias("artifact_qualname"), F.col("read.front").alias("frontmatter"),
    )
    return one.select(
        "path", F.struct(doc.alias("id"), F.lit("Document").alias("label"), about.alias("properties")).alias("document"), F.transform("listed", chunk).alias("chunks"),
        F.transform(new, lambda x: F.struct(x["id"].alias("id"), F.lit("MarkdownSection").alias("label"), F.element_at("held", x["section"]).alias("properties"))).alias("nodes"),
        F.transform(new, lambda x: F.struct(x["above"].alias("from_id"), x["id"].alias("to_id"), F.lit("CONTAINS").alias("rel_type"), F.lit(None).cast("string").alias("kind"))).alias("edges"),
    )
