"""Knowledge bases and their links, links between artifacts, and annotations of nodes, as tables.

Links need both ends to exist and a kind of the closed vocabulary: a kind that is none is an error at
run time, links without an end come back as a table of their own. Changes of one key in one batch
apply in the order of ``created_at`` and content, so results do not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorestone.model import KB_LINK_KINDS, RELATES_KINDS, checked
from lorestone.operators.graph import merge_relates
from lorestone.operators.incremental import latest

LINK_KEY = ("from_kb", "to_kb", "kind")
RESERVED_LABELS = ("Kb", "_Meta")


def upsert_kbs(kbs: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """``kbs(name, project_root, tags, metadata_json, created_at, updated_at)`` after ``changes`` of all but the times; a
    known name keeps the time of its creation."""
    fresh = latest(changes, ["name"], [F.col("project_root").desc_nulls_last(), F.to_json(F.struct("tags", "metadata_json")).desc()])
    old = kbs.select("name", F.col("created_at").alias("old_created"))
    fresh = fresh.join(old, "name", "left").withColumns({"created_at": F.coalesce("old_created", now), "updated_at": now, "metadata_json": F.coalesce("metadata_json", F.lit("{}"))})
    return kbs.join(fresh.select("name"), "name", "left_anti").unionByName(fresh.select(*kbs.columns))


def list_kbs(kbs: DataFrame, prefix: str | None = None, tag: str | None = None) -> DataFrame:
    if prefix:
        kbs = kbs.filter(F.col("name").startswith(prefix))
    return (kbs.filter(F.array_contains("tags", tag)) if tag else kbs).orderBy("name")


def get_kb(kbs: DataFrame, name: str) -> DataFrame:
    return kbs.filter(F.col("name") == name)


def delete_kbs(kbs: DataFrame, links: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tables without the knowledge bases ``names(name)`` and all links at them."""
    for end in ("from_kb", "to_kb"):
        links = links.join(names.select(F.col("name").alias(end)), end, "left_anti")
    return kbs.join(names, "name", "left_anti"), links


def with_ends(rows: DataFrame, nodes: DataFrame, ends: Sequence[str], key: str) -> tuple[DataFrame, DataFrame]:
    """Rows both of whose ends exist, and the others."""
    ids = nodes.select(F.col(key).alias("__id")).distinct()
    for k, end in enumerate(ends):
        here = ids.select(F.col("__id").alias(f"__end{k}"), F.lit(True).alias(f"__has{k}"))
        rows = rows.join(here, F.col(end) == F.col(f"__end{k}"), "left").drop(f"__end{k}")
    both = F.coalesce(F.col("__has0") & F.col("__has1"), F.lit(False))
    return rows.filter(both).drop("__has0", "__has1"), rows.filter(~both).drop("__has0", "__has1")


def link_kbs(links: DataFrame, added: DataFrame, kbs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``links(from_kb, to_kb, kind, created_at, metadata_json)`` with those added, and the ones that lack an end. A known
    link keeps its time and takes the new metadata."""
    added = added.withColumn("kind", checked(F.col("kind"), KB_LINK_KINDS, "kind of link"))
    whole, lacking = with_ends(added, kbs, ("from_kb", "to_kb"), "name")
    fresh = latest(whole, LINK_KEY, [F.desc("created_at"), F.desc("metadata_json")])
    first = whole.groupBy(*LINK_KEY).agg(F.min("created_at").alias("first_created"))
    old = links.select(*LINK_KEY, F.col("created_at").alias("old_created"))
    fresh = fresh.join(first, list(LINK_KEY)).join(old, list(LINK_KEY), "left").withColumn("created_at", F.coalesce("old_created", "first_created"))
    return links.join(fresh.select(*LINK_KEY), list(LINK_KEY), "left_anti").unionByName(fresh.select(*links.columns)), lacking


def unlink(links: DataFrame, gone: DataFrame, key: Sequence[str] = LINK_KEY) -> DataFrame:
    return links.join(gone.select(*key).distinct(), list(key), "left_anti")


def deleted(table: DataFrame, gone: DataFrame, key: Sequence[str]) -> DataFrame:
    """How many rows a deletion by key takes: ``(deleted)``, one row."""
    return table.join(gone.select(*key).distinct(), list(key), "left_semi").agg(F.count("*").alias("deleted"))


def links_of(links: DataFrame, name: str, direction: str = "both", ends: tuple[str, str] = ("from_kb", "to_kb")) -> DataFrame:
    """Links out of a name, into it, or both, with ``direction``; a link to itself is out and in."""
    out = links.filter(F.col(ends[0]) == name).withColumn("direction", F.lit("out"))
    into = links.filter(F.col(ends[1]) == name).withColumn("direction", F.lit("in"))
    return {"out": out, "in": into, "both": out.unionByName(into)}[direction]


def link_counts(kbs: DataFrame, links: DataFrame) -> DataFrame:
    """Every knowledge base with its links in and out, 0 if it has none."""
    out = links.groupBy(F.col("from_kb").alias("name")).agg(F.count("*").alias("links_out"))
    into = links.groupBy(F.col("to_kb").alias("name")).agg(F.count("*").alias("links_in"))
    return kbs.join(out, "name", "left").join(into, "name", "left").fillna(0, ["links_out", "links_in"])


def link_artifacts(edges: DataFrame, added: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """RELATES edges with ``added(from_id, to_id, kind, author, metadata_json)``, and those that lack an end or a kind.
    Author and metadata go into the edge's properties over old ones."""
    added = added.withColumn("kind", checked(F.col("kind"), RELATES_KINDS, "kind of relation"))
    whole, lacking = with_ends(added.filter("kind is not null"), nodes, ("from_id", "to_id"), "id")
    named = F.map_filter(F.create_map(F.lit("author"), F.col("author"), F.lit("metadata_json"), F.col("metadata_json")), lambda k, v: v.isNotNull())
    fresh = whole.select("from_id", "to_id", F.lit("RELATES").alias("rel_type"), "kind", named.alias("properties"))
    return merge_relates(edges, fresh), lacking.unionByName(added.filter("kind is null"))


def unlink_artifacts(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without the RELATES edges ``gone(from_id, to_id, kind)``."""
    return edges.filter("rel_type <> 'RELATES'").unionByName(unlink(edges.filter("rel_type = 'RELATES'"), gone, ("from_id", "to_id", "kind")))


def relates_of(edges: DataFrame, node: str, direction: str = "both") -> DataFrame:
    return links_of(edges.filter("rel_type = 'RELATES'"), node, direction, ("from_id", "to_id"))


def author(explicit: Column, client: Column) -> Column:
    """Who wrote: as said, else the client's agent, else nobody known."""
    named = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(named(explicit), F.concat(F.lit("agent:"), named(client)), F.lit("user:unknown"))


def target_snapshot(nodes: DataFrame) -> DataFrame:
    """``(target_id, target_snapshot)``: JSON of what a node was, for annotations that outlive it."""
    said = F.coalesce(*[F.col("properties")[k] for k in ("breadcrumb", "qualname", "name")])
    return nodes.select(F.col("id").alias("target_id"), F.to_json(F.struct(F.col("id").alias("target_id"), F.col("label").alias("target_kind"), said.alias("breadcrumb"))).alias("target_snapshot"))


def annotations_of(annotations: DataFrame, node: str) -> DataFrame:
    return annotations.filter(F.col("target_id") == node).orderBy("created_at", "id")


def delete_annotations(annotations: DataFrame, ids: DataFrame) -> DataFrame:
    return annotations.join(ids.select("id").distinct(), "id", "left_anti")


def with_targets(annotations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Annotations with their target's label and name, which are null where the target is gone."""
    there = nodes.select(F.col("id").alias("target_id"), F.col("label").alias("target_label"), F.col("properties")["name"].alias("target_name"))
    return annotations.join(there, "target_id", "left")


def roots(kbs: DataFrame, own: str, federation: str = "federation") -> DataFrame:
    """``(id, label, kind, parent)``: the federation and the local knowledge base under it."""
    top = kbs.sparkSession.createDataFrame([(federation, federation, "federation", None)], "id string, label string, kind string, parent string")
    return top.unionByName(get_kb(kbs, own).select(F.col("name").alias("id"), F.col("name").alias("label"), F.lit("kb").alias("kind"), F.lit(federation).alias("parent")))


def web_edges(edges: DataFrame) -> DataFrame:
    """Edges as views show them: source, target, and the kind or else the type."""
    return edges.select(F.col("from_id").alias("source"), F.col("to_id").alias("target"), F.coalesce("kind", F.lower("rel_type")).alias("kind"))
