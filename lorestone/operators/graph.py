"""A property graph as two tables, nodes and edges, and the joins that read and change it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorestone.sources.scratch import written

#: Steps after which what was reached is written as one table, so plans stay small however deep the graph is.
UNIONS = 16
#: Rows that are sent to all tasks at most.
FEW = 20_000
EDGE_KEY = ("from_id", "to_id", "rel_type", "kind")


def with_both_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends exist. Others stay in storage until their nodes come."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")


def missing_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_anti").union(edges.join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_anti")).distinct()


def selected(edges: DataFrame, rel_type: str = "both", kind: str | None = None, kind_applies_to: str = "all") -> DataFrame:
    """Edges of a type and kind; ``relates`` leaves CONTAINS edges, which have no kind, in."""
    if rel_type != "both":
        edges = edges.filter(F.col("rel_type") == rel_type)
    if kind is not None:
        of_kind = F.coalesce(F.col("kind") == kind, F.lit(False))
        edges = edges.filter(of_kind if kind_applies_to == "all" else of_kind | (F.col("rel_type") != "RELATES"))
    return edges


def steps(edges: DataFrame, direction: str = "both") -> DataFrame:
    """``(here, there)`` for every way along an edge."""
    out = edges.select(F.col("from_id").alias("here"), F.col("to_id").alias("there"))
    back = edges.select(F.col("to_id").alias("here"), F.col("from_id").alias("there"))
    return {"out": out, "in": back, "both": out.union(back)}[direction]


def reach(nodes: DataFrame, ways: DataFrame, roots: Column, depth: int | None = None) -> DataFrame:
    """``(id, distance)`` of the nodes up to ``depth`` steps from the roots, or of all there are, one join a step. As long as
    a step's nodes are few, which a count shows, they are sent to the ways and to the nodes, and neither is shuffled."""
    ids = nodes.select("id")
    edge = written(nodes.filter(roots).select("id", F.lit(0).alias("distance")))
    found, total, n, d = edge, edge.count(), edge.count(), 0
    while n and (depth is None or d < depth):
        d += 1
        near = ways.join(F.broadcast(edge) if n <= FEW else edge, edge["id"] == ways["here"], "left_semi").select(F.col("there").alias("id")).distinct()
        near = near.join(F.broadcast(found) if total <= FEW else found, "id", "left_anti")
        if n <= FEW:
            near = written(near)
            few = near.limit(FEW + 1).count() <= FEW
        else:
            few = False
        edge = ids.join(F.broadcast(near), "id", "left_semi") if few else near.join(ids, "id", "left_semi")
        edge = written(edge.select("id", F.lit(d).alias("distance")))
        n = edge.count()
        total += n
        found = written(found.union(edge)) if d % UNIONS == 0 else found.union(edge)
    return found


def neighbors(nodes: DataFrame, edges: DataFrame, root: str, depth: int = 1, limit: int = 50, direction: str = "both") -> tuple[DataFrame, DataFrame]:
    """Nodes by distance and id, the root among them, up to the limit; and the edges on the ways to them. An edge
    between two nodes of the greatest distance is on no way."""
    kept = written(reach(nodes, steps(edges, direction), F.col("id") == root, depth).orderBy("distance", "id").limit(limit))
    walked = kept.filter(F.col("distance") < depth).select("id")
    out, into = (edges.join(walked.select(F.col("id").alias(end)), end, "left_semi").select(*edges.columns) for end in ("from_id", "to_id"))
    ways = {"out": out, "in": into, "both": out.unionByName(into.join(walked.select(F.col("id").alias("from_id")), "from_id", "left_anti").select(*edges.columns))}[direction]
    return kept, with_both_ends(ways, kept)


def descendants(nodes: DataFrame, edges: DataFrame, root: Column, depth: int | None = None) -> DataFrame:
    """Ids below the roots along CONTAINS edges, the roots among them; all of them if no depth is given."""
    return reach(nodes, steps(edges.filter("rel_type = 'CONTAINS'"), "out"), root, depth).select("id")


def degree(edges: DataFrame) -> DataFrame:
    """Edges in and out of each node; sums combine before they shuffle, so hubs are cheap."""
    out = edges.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("n"))
    into = edges.groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("n"))
    return out.union(into).groupBy("id").agg(F.sum("n").alias("degree"))


def describe(nodes: DataFrame, edges: DataFrame, annotations: DataFrame) -> DataFrame:
    """Nodes with their annotations and links in and out, each side gathered before it is joined."""
    relates = edges.filter("rel_type = 'RELATES'")
    out = relates.groupBy(F.col("from_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("to_id", "kind"))).alias("links_out"))
    into = relates.groupBy(F.col("to_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("from_id", "kind"))).alias("links_in"))
    notes = annotations.filter("target_id is not null").groupBy(F.col("target_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("created_at", F.col("id").alias("annotation_id"), "kind", "body"))).alias("annotations"))
    return nodes.join(notes, "id", "left").join(out, "id", "left").join(into, "id", "left")


def find(nodes: DataFrame, name: str | None = None, qualname: str | None = None, label: str | Sequence[str] | None = None, tag: str | Sequence[str] | None = None, kb: str | None = None, limit: int = 50) -> DataFrame:
    """Artifacts by prefixes of name and qualified name, any of some labels, any of some tags, and knowledge base, in id
    order. Knowledge bases and the store's own records are no artifacts."""
    wanted = F.col("id").isNotNull() & ~F.coalesce(F.col("label").isin("Kb", "_Meta"), F.lit(False)) if "label" in nodes.columns else F.col("id").isNotNull()
    several = lambda v: [v] if isinstance(v, str) else list(v)
    for value, test in ((name, lambda v: F.col("name").startswith(v)), (qualname, lambda v: F.col("qualname").startswith(v)), (label, lambda v: F.col("label").isin(several(v))), (tag, lambda v: F.arrays_overlap("tags", F.array(*map(F.lit, several(v))))), (kb, lambda v: F.col("kb_name") == v)):
        if value is not None:
            wanted = wanted & test(value)
    return nodes.filter(wanted).orderBy("id").limit(limit)


def upsert_nodes(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """New properties go over old ones; old keys stay."""
    old = nodes.select("id", F.col("label").alias("old_label"), F.col("kb_name").alias("old_kb"), F.col("properties").alias("old"))
    empty = F.create_map().cast("map<string,string>")
    both = old.join(changes, "id", "full")
    # of a key that both have, the change's value comes last and stays
    merged = F.map_concat(F.map_filter(F.coalesce("old", empty), lambda k, v: ~F.map_contains_key(F.coalesce("properties", empty), k)), F.coalesce("properties", empty))
    return both.select("id", F.coalesce("label", "old_label").alias("label"), F.coalesce("kb_name", "old_kb").alias("kb_name"), merged.alias("properties"))


def _over(old: str, new: str) -> Column:
    """Properties of ``new`` over those of ``old``."""
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(F.col(old), empty), F.coalesce(F.col(new), empty)
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def one_each(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row of each key, the same on every run: maps count by their sorted entries."""
    said = F.to_json(F.struct(*[F.array_sort(F.map_entries(c)).alias(c) if rows.schema[c].dataType.typeName() == "map" else F.col(c) for c in rows.columns]))
    place = F.row_number().over(W.partitionBy(*keys).orderBy(said))
    return rows.withColumn("__place", place).filter("__place = 1").drop("__place")


def merge_relates(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """``edges`` with ``changes``: one edge for each pair of ends, type and kind, new properties over old ones. One full
    join, in which an edge of no kind equals another."""
    old = edges.select(*[F.col(k).alias(f"old_{k}") for k in EDGE_KEY], F.col("properties").alias("old"))
    fresh = one_each(changes, EDGE_KEY).select(*[F.col(k).alias(f"new_{k}") for k in EDGE_KEY], F.col("properties").alias("new"))
    both = old.join(fresh, [F.col(f"old_{k}").eqNullSafe(F.col(f"new_{k}")) for k in EDGE_KEY], "full")
    kept = F.when(F.col("new_from_id").isNull(), F.col("old")).when(F.col("old_from_id").isNull(), F.col("new")).otherwise(_over("old", "new"))
    return both.select(*[F.coalesce(f"new_{k}", f"old_{k}").alias(k) for k in EDGE_KEY], kept.alias("properties"))


def merge_edges(edges: DataFrame, order: Sequence[Column]) -> DataFrame:
    """One edge for each pair of ends, type and kind: the first in the order."""
    place = F.row_number().over(W.partitionBy(*EDGE_KEY).orderBy(*order))
    return edges.withColumn("__place", place).filter("__place = 1").drop("__place")


def delete_nodes(nodes: DataFrame, edges: DataFrame, victims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without the victims ``(id)`` and all edges at them."""
    kept = edges
    for end in ("from_id", "to_id"):
        kept = kept.join(victims.select(F.col("id").alias(end)), end, "left_anti")
    return nodes.join(victims, "id", "left_anti"), kept.select(*edges.columns)


def orphan(annotations: DataFrame, victims: DataFrame, now: Column) -> DataFrame:
    """Annotations of the victims lose their target and stay."""
    gone = victims.select(F.col("id").alias("target_id"), F.lit(True).alias("gone"))
    both = annotations.join(gone, "target_id", "left")
    return both.withColumn("updated_at", F.when(F.col("gone"), now).otherwise(F.col("updated_at"))).withColumn("target_id", F.when(F.col("gone").isNull(), F.col("target_id"))).select(*annotations.columns)


def orphans(annotations: DataFrame, nodes: DataFrame, limit: int | None = None, order: Sequence[str] = ("created_at", "id")) -> DataFrame:
    """Annotations whose target is not there: all, or the first ones in the order."""
    found = annotations.join(nodes.select(F.col("id").alias("target_id")), "target_id", "left_anti").select(*annotations.columns)
    return found if limit is None else found.orderBy(*order).limit(limit)


def reattach(annotations: DataFrame, nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """Targets for annotations that are orphans, where the new target ``moves(id, new_target)`` exists."""
    live = moves.join(nodes.select(F.col("id").alias("new_target")), "new_target", "left_semi")
    there = nodes.select(F.col("id").alias("target_id"), F.lit(True).alias("there"))
    both = annotations.join(there, "target_id", "left").join(live, "id", "left")
    return both.withColumn("target_id", F.when(F.col("there").isNull() & F.col("new_target").isNotNull(), F.col("new_target")).otherwise(F.col("target_id"))).select(*annotations.columns)


def annotate(annotations: DataFrame, added: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Summaries take the place of the target's last one, with its id and time of creation; others are added. Of a batch's
    summaries for one target the last one counts. Those whose target is not among the nodes come back as a second table."""
    ids = nodes.select(F.col("id").alias("target_id")).distinct()
    lacking, added = added.join(ids, "target_id", "left_anti").select(*added.columns), added.join(ids, "target_id", "left_semi").select(*added.columns)
    last = F.row_number().over(W.partitionBy("target_id").orderBy(F.desc("created_at"), F.desc("id")))
    summaries = added.filter("kind = 'summary'").withColumn("__place", last).filter("__place = 1").drop("__place")
    added = added.filter("kind <> 'summary'").unionByName(summaries)
    old = annotations.filter("kind = 'summary'").select(F.col("target_id").alias("old_target"), F.col("id").alias("old_id"), F.col("created_at").alias("old_created"))
    fresh = added.join(old, (F.col("target_id") == F.col("old_target")) & (F.col("kind") == "summary"), "left")
    fresh = fresh.withColumn("id", F.coalesce("old_id", "id")).withColumn("created_at", F.coalesce("old_created", "created_at")).select(*annotations.columns)
    return annotations.join(fresh.select("id"), "id", "left_anti").unionByName(fresh), lacking


def reconcile(nodes: DataFrame, edges: DataFrame, members: DataFrame, annotations: DataFrame, parsed_docs: DataFrame, parsed_nodes: DataFrame, parsed_edges: DataFrame, now: Column, depth: int | None = None) -> dict[str, DataFrame]:
    """Take over the parse results of many documents at once.

    ``members(doc_id, id)`` says which document holds a node; ``parsed_docs`` and ``parsed_nodes`` are
    nodes, the latter with ``doc_id``. What no document holds any more goes, with all below it; its
    annotations stay as orphans. Outbound RELATES edges of the documents' nodes are replaced.
    """
    docs = parsed_docs.select(F.col("id").alias("doc_id"))
    current = parsed_nodes.select("doc_id", "id").distinct()
    others = members.join(docs, "doc_id", "left_anti")
    members_now = others.unionByName(current)
    lost = members.join(docs, "doc_id", "left_semi").select("id").distinct().join(members_now.select("id"), "id", "left_anti")
    lost = written(lost)
    everyone = nodes.select("id").union(lost).distinct()
    below = reach(everyone.join(lost.withColumn("lost", F.lit(True)), "id", "left"), steps(edges.filter("rel_type = 'CONTAINS'"), "out"), F.col("lost"), depth).select("id")
    victims = written(below.join(members_now.select("id"), "id", "left_anti").distinct())
    nodes, edges = delete_nodes(nodes, edges, victims)
    nodes = upsert_nodes(nodes, one_each(parsed_docs.unionByName(parsed_nodes.drop("doc_id")), ["id"]))
    owned = members.join(docs, "doc_id", "left_semi").select("id").union(docs.select(F.col("doc_id").alias("id"))).distinct()
    stale = edges.filter("rel_type = 'RELATES'").join(owned.withColumnRenamed("id", "from_id"), "from_id", "left_semi")
    edges = edges.join(stale.select(*EDGE_KEY), [edges[k].eqNullSafe(stale[k]) for k in EDGE_KEY], "left_anti")
    # a relation needs a kind
    edges = merge_relates(edges, parsed_edges.filter("rel_type <> 'RELATES' or kind is not null"))
    return {"nodes": nodes, "edges": edges, "members": members_now, "annotations": orphan(annotations, victims, now)}


def delete_document(nodes: DataFrame, edges: DataFrame, members: DataFrame, annotations: DataFrame, docs: DataFrame, now: Column) -> dict[str, DataFrame]:
    """The graph without ``docs(id)``: what they alone hold goes with all below it, annotations stay as orphans."""
    gone = docs.select(F.col("id").alias("doc_id"))
    kept = members.join(gone, "doc_id", "left_anti")
    heads = docs.select("id").union(members.join(gone, "doc_id", "left_semi").select("id")).distinct()
    heads = heads.join(kept.select("id"), "id", "left_anti").withColumn("head", F.lit(True))
    below = reach(nodes.select("id").join(heads, "id", "left"), steps(edges.filter("rel_type = 'CONTAINS'"), "out"), F.col("head"))
    victims = written(below.select("id").join(kept.select("id"), "id", "left_anti").distinct())
    nodes, edges = delete_nodes(nodes, edges, victims)
    return {"nodes": nodes, "edges": edges, "members": kept, "annotations": orphan(annotations, victims, now)}


def graph_shape(cells: DataFrame, federation: str = "federation") -> tuple[DataFrame, DataFrame]:
    """``cells(id, label, kind, source, target)`` as nodes, each id once, and edges."""
    edge = F.col("source").isNotNull() & F.col("target").isNotNull() & F.col("kind").isNotNull()
    edges = cells.filter(edge).select("source", "target", "kind")
    nodes = cells.filter(~edge & F.col("id").isNotNull() & (F.col("id") != federation))
    nodes = nodes.groupBy("id").agg(F.min(F.struct(F.coalesce("label", "id").alias("label"), F.coalesce("kind", F.lit("unknown")).alias("kind"))).alias("x"))
    return nodes.select("id", "x.label", "x.kind"), edges


def kind_view(nodes: DataFrame, edges: DataFrame, kinds: Sequence[str] = ("document", "kb")) -> tuple[DataFrame, DataFrame]:
    kept = nodes.filter(F.col("kind").isin(*kinds))
    return kept, with_both_ends(edges, kept)
