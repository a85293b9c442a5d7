"""Nested properties as variants, and values of any type as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parsed(text: Column) -> Column:
    """JSON as a variant, nested parts and all; null for what is none."""
    return F.try_parse_json(text)


def field(value: Column, path: str, kind: str = "string") -> Column:
    """A part of a variant by its path (``$.a.b[0]``); null if it is not there or of another kind."""
    return F.try_variant_get(value, path, kind)


def shape(rows: DataFrame, column: str) -> str:
    """The schema that all variants of a column share, by one aggregation."""
    return rows.agg(F.schema_of_variant_agg(column)).first()[0]


def plain(value: Column, kind: T.DataType) -> Column:
    """A value with all that JSON has no type for made text, at any depth: bytes as lower-case hexadecimal digits, dates and times by ISO
    8601, keys as text."""
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(value))
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS" + ("XXX" if isinstance(kind, T.TimestampType) else ""))
    if isinstance(kind, T.DateType | T.DayTimeIntervalType | T.YearMonthIntervalType):
        return value.cast("string")
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: plain(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].cast("string").alias("key"), plain(e["value"], kind.valueType).alias("value"))))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[plain(value[f.name], f.dataType).alias(f.name) for f in kind]))
    return value


def as_json(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with those columns as JSON text; a null is ``null``."""

    def said(c: str) -> Column:
        held = F.to_json(F.struct(plain(F.col(c), rows.schema[c].dataType).alias("v")), {"ignoreNullFields": "false"})  # {"v":...}
        return F.regexp_extract(held, r'(?s)^\{"v":(.*)\}$', 1)

    return rows.withColumns({c: said(c) for c in columns})


def node_value(id_: Column, labels: Column, properties: Column) -> Column:
    """A node as a cell of a result."""
    return F.struct(F.lit("node").alias("_type"), id_.alias("id"), F.array_sort(labels).alias("labels"), properties.alias("properties"))


def relationship_value(id_: Column, kind: Column, start: Column, end: Column, properties: Column) -> Column:
    return F.struct(F.lit("relationship").alias("_type"), id_.alias("id"), kind.alias("type"), start.alias("start"), end.alias("end"), properties.alias("properties"))


def path_value(nodes: Column, relationships: Column) -> Column:
    return F.struct(F.lit("path").alias("_type"), nodes.alias("nodes"), relationships.alias("relationships"))
