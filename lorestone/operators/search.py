"""Vector search, its filters, and search over several knowledge bases."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import dataset
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorestone.functions import vectors
from lorestone.sources.scratch import written

EXCERPT = 200
#: Vectors that meet in one matrix product, of either side.
BLOCK = 2_048


def ranked(chunks: DataFrame, query: Sequence[float], vector: str = "vector") -> DataFrame:
    """``chunks`` with ``distance`` to the query and ``score``; the query is a literal, so no join."""
    return chunks.withColumn("distance", F.round(vectors.squared_distance(F.col(vector), vectors.literal(query)), 6)).withColumn("score", F.round(vectors.score(F.col("distance")), 6))


def top_k(chunks: DataFrame, query: Sequence[float], key: str, k: int = 10, vector: str = "vector") -> DataFrame:
    """The k nearest, ties by key: each task keeps k rows, so what moves does not grow with the table."""
    return ranked(chunks, query, vector).orderBy("distance", key).limit(k)


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = pc.list_flatten(column)
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _nearest(batches: Iterator[pa.RecordBatch], folder: str, k: int) -> Iterator[pa.RecordBatch]:
    """The k nearest of this task's chunks for every query, block by block: squared distances are a matrix product, of which only
    what may be among the k nearest is computed exactly."""
    queries = dataset.dataset(folder, format="parquet")
    best: dict[int, tuple[np.ndarray, pa.Array]] = {}  # by block of queries: distances and keys, k a query
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            c, keys = _vectors(part.column("vector")), part.column("key")
            norms = (c * c).sum(1)
            for b, block in enumerate(queries.to_batches(columns=["query_vector"], batch_size=BLOCK)):
                q = _vectors(block.column(0))
                own = (q * q).sum(1)
                near = own[:, None] + norms[None, :] - 2 * (q @ c.T)
                slack = 2e-6 + 1e-9 * (own[:, None] + norms.max(initial=0.0))
                most = np.partition(near, k - 1, 1)[:, k - 1 : k] if len(c) > k else np.full((len(q), 1), np.inf)
                held = best.get(b)
                if held is not None:
                    most = np.minimum(most, held[0][:, -1:])  # a block whose nearest is farther has nothing to add
                row, col = np.nonzero(near <= most + slack)
                exact = np.round(((q[row] - c[col]) ** 2).sum(1), 6)
                best[b] = _best(len(q), k, row, exact, keys.take(pa.array(col)), held)
    for b, block in enumerate(queries.to_batches(columns=["query_id"], batch_size=BLOCK) if best else ()):
        distance, keys = best[b]
        row, place = np.nonzero(np.isfinite(distance))
        yield pa.RecordBatch.from_arrays([block.column(0).take(pa.array(row)), keys.take(pa.array(row * k + place)), pa.array(distance[row, place])], ["query_id", "key", "distance"])


def _best(n: int, k: int, row: np.ndarray, distance: np.ndarray, keys: pa.Array, held: tuple | None) -> tuple[np.ndarray, pa.Array]:
    """The k least by distance and key of each of n queries, among candidates and those held."""
    if held is not None:
        old, place = np.nonzero(np.isfinite(held[0]))
        row, distance = np.concatenate([old, row]), np.concatenate([held[0][old, place], distance])
        keys = pa.concat_arrays([held[1].take(pa.array(old * k + place)), keys])
    order = pc.sort_indices(pa.table({"row": row, "distance": distance, "key": keys}), sort_keys=[("row", "ascending"), ("distance", "ascending"), ("key", "ascending")]).to_numpy()
    row = row[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < k
    out, at = np.full((n, k), np.inf), np.full(n * k, -1)
    out[row[keep], place[keep]] = distance[order[keep]]
    at[row[keep] * k + place[keep]] = order[keep]
    return out, keys.take(pa.array(np.where(at < 0, None, at), pa.int64()))


def top_k_each(queries: DataFrame, chunks: DataFrame, key: str, k: int = 10) -> DataFrame:
    """``(query_id, key, distance, place)``: the k nearest of ``chunks(key, vector)`` for each of ``queries(query_id, query_vector)``, however many
    there are; ties by key. Exact, without a cross join.

    Queries are written to the shared folder; every task reads them block by block against its own chunks and keeps k a query, so what
    moves is k rows a query and task. Chunks are dealt to as many tasks as there are cores, as fewer tasks pass on less. Nulls are not near anything."""
    spark = queries.sparkSession
    kind, own = chunks.schema[key].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    numbered = queries.filter("query_vector is not null").select("query_id", "query_vector")
    place = written(numbered)
    if place.isEmpty():
        return spark.createDataFrame([], f"query_id {own}, {key} {kind}, distance double, place int")
    folder = place.inputFiles()[0].rpartition("/")[0]
    rows = chunks.filter("vector is not null").select(F.col(key).alias("key"), "vector").coalesce(spark.sparkContext.defaultParallelism)
    found = rows.mapInArrow(partial(_nearest, folder=folder, k=k), f"query_id {own}, key {kind}, distance double")
    ranked = found.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("distance", "key"))).filter(F.col("place") <= k)
    return ranked.select("query_id", F.col("key").alias(key), "distance", "place")


def label_like(labels_json: Column, value: str) -> Column:
    """Substring match on the labels' JSON text; per cent and underscore in the value stay wildcards."""
    return labels_json.like(f"%{value}%")


def has_labels(labels: Column, wanted: Sequence[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), labels)) == 0


def best_per_document(hits: DataFrame, document: str, key: str) -> DataFrame:
    """Of hits that are limited already, the best one of each document."""
    place = F.row_number().over(W.partitionBy(document).orderBy("distance", key))
    return hits.withColumn("place", place).filter("place = 1").drop("place")


def excerpt(text: Column, size: int = EXCERPT) -> Column:
    return F.substring(text, 1, size)


def federated(chunks: DataFrame, query: Sequence[float], peer: str, key: str, k: int = 10, vector: str = "vector") -> DataFrame:
    """The k nearest of every peer, the best scores of all first, without a limit over all. Salted first, so that a peer with most of the
    rows is ranked by many tasks before its winners meet."""
    near = ranked(chunks, query, vector).withColumn("salt", F.pmod(F.xxhash64(key), F.lit(64)))
    near = near.withColumn("place", F.row_number().over(W.partitionBy(peer, "salt").orderBy("distance", key))).filter(F.col("place") <= k)
    return near.withColumn("place", F.row_number().over(W.partitionBy(peer).orderBy("distance", key))).filter(F.col("place") <= k).drop("salt").orderBy(F.desc("score"), peer, key)


def by_peer(hits: DataFrame, peers: DataFrame, peer: str, key: str) -> DataFrame:
    """``peers(peer, status)``, each with its hits in order; a peer that is not alive is unreachable and has none."""
    listed = hits.groupBy(peer).agg(F.array_sort(F.collect_list(F.struct("distance", key, "score"))).alias("hits"))
    out = peers.join(listed, peer, "left").withColumn("unreachable", ~F.col("status").eqNullSafe("alive"))
    return out.withColumn("hits", F.when(~F.col("unreachable"), F.coalesce("hits", F.array().cast(listed.schema["hits"].dataType))))


def checked_request(query: str, n: int = 20) -> tuple[str, int]:
    """A search's text and number of results, if they are within bounds."""
    if not 1 <= len(query) <= 500:
        raise ValueError("a query has 1 to 500 characters")
    if not 1 <= n <= 100:
        raise ValueError("a search gives 1 to 100 results")
    return query, n


def search_text(chunks: DataFrame, query: str, embedder, key: str, k: int = 10, filters: dict[str, Sequence[str]] | None = None, labels_json: str = "labels_json") -> DataFrame:  # noqa: ANN001
    """The k nearest to a text. Filters are substrings of the labels' JSON, all of which must be there; no other column
    can be filtered on."""
    if set(filters or ()) - {"labels"}:
        raise ValueError("only labels can be filtered on")
    for value in (filters or {}).get("labels", ()):
        chunks = chunks.filter(label_like(F.col(labels_json), value))
    return top_k(chunks, [float(x) for x in embedder([query])[0]], key, k)


def pivot_to_nodes(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hits with the graph node that their chunk is about."""
    return hits.join(nodes.select(F.col("id").alias("artifact_qualname"), F.col("label").alias("node_label"), F.col("properties").alias("node_properties")), "artifact_qualname")
