"""Sharding by a k-d tree over metadata, DataFrame functions only.

A node is split along its widest dimension at the weighted quantile that fits the number of leaves
on either side. The quantile is found by refining a histogram of a 60-bit ordering key (20 bits of
position in the node, 40 bits of the text's hash), 15 bits a pass: what moves is a bounded number
of bucket sums per node. Equal texts have equal keys and so stay together, unless the group that
straddles the cut would move it by more than ``slack`` of a leaf: then it is split by id.

Defined results: a null text counts no bytes; every row weighs at least 1, so an empty table is the
only one with no rows to cut; repeated rows are separate rows; more shards than distinct rows leave
shards empty. Only doc_id and text are read, other columns play no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorestone.llm.common import materialize, unused, values

BITS, STEP = 60, 15
POSITION, HASH = 20, 40
#: Rows of one shard that are numbered in one task.
SLOT_ROWS = 50_000


def text_metadata(text: Column) -> dict[str, Column]:
    """The dimensions: log of the bytes, and words, lines and non-ASCII bytes per byte."""
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 1
    chars = F.coalesce(F.length(text), F.lit(0))
    share = lambda n: F.coalesce(n, F.lit(0)) / size
    return {
        "d0": F.log2(size.cast("double")),
        "d1": share(F.length(text) - F.length(F.translate(text, " ", ""))),
        "d2": share(F.length(text) - F.length(F.translate(text, "\n", ""))),
        "d3": (size - 1 - chars) / size,
    }


def _hash_bits(column: Column, bits: int) -> Column:
    return F.shiftrightunsigned(column, 64 - bits)


def _quantile(rows: DataFrame, key: str, wanted: dict[int, float]) -> dict[int, tuple[int, int, int]]:
    """Per node the key at which its running weight first exceeds what is wanted, the weight below
    that key and the weight at it. One small row per node comes to the driver in each pass."""
    spark = rows.sparkSession
    found = {n: (0, 0, 0) for n in wanted}
    for shift in range(BITS - STEP, -1, -STEP):
        goal = values(spark, [(n, found[n][0], float(wanted[n]) - found[n][1]) for n in wanted], "node prefix goal")
        part = rows.join(goal, "node").filter(F.shiftright(key, shift + STEP) == F.col("prefix"))
        sums = part.groupBy("node", "goal", F.shiftright(key, shift).alias("bucket")).agg(F.sum("size").alias("w"))
        run = F.sum("w").over(W.partitionBy("node").orderBy("bucket"))
        last = F.max("bucket").over(W.partitionBy("node"))
        hit = sums.withColumns({"run": run, "last": last}).filter((F.col("run") > F.col("goal")) | (F.col("bucket") == F.col("last")))
        for r in hit.groupBy("node").agg(F.min(F.struct("bucket", "run", "w")).alias("m")).select("node", "m.*").collect():
            found[r["node"]] = (r["bucket"], found[r["node"]][1] + r["run"] - r["w"], r["w"])
    return found


def kd_assign(rows: DataFrame, dims: Sequence[str], shards: int, slack: float = 0.01) -> DataFrame:
    """``rows`` with ``node``, its shard. Needs ``size``, ``text_hash``, ``id_hash`` and ``dims``.

    The driver holds one record per open node, so at most ``shards`` of them.
    """
    spark = rows.sparkSession
    placed = rows.withColumn("node", F.lit(0).cast("long"))
    leaves = {0: shards}  # a node is named after its first shard
    ranges = rows.agg(F.sum("size").alias("total"), *[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]).first()
    wide = {d: max((ranges[f"hi_{d}"] or 0) - (ranges[f"lo_{d}"] or 0), 1e-12) for d in dims}
    allowed = slack * (ranges["total"] or 0) / shards
    while any(n > 1 for n in leaves.values()):
        open_nodes = values(spark, [(n,) for n, k in leaves.items() if k > 1], "node")
        stats = placed.join(open_nodes, "node").groupBy("node").agg(F.sum("size").alias("total"), *[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]).collect()
        cut_on, goals = [], {}
        for r in stats:
            axis = max(range(len(dims)), key=lambda i: (r[f"hi_{dims[i]}"] - r[f"lo_{dims[i]}"]) / wide[dims[i]])
            lo, hi = r[f"lo_{dims[axis]}"], r[f"hi_{dims[axis]}"]
            cut_on.append((r["node"], axis, float(lo), float(hi - lo) or 1.0))
            goals[r["node"]] = r["total"] * (leaves[r["node"]] // 2) / leaves[r["node"]]
        if goals:
            axes = values(spark, cut_on, "node axis low span")
            position = F.least(F.floor((F.element_at(F.array(*dims), (F.col("axis") + 1).cast("int")) - F.col("low")) / F.col("span") * (1 << POSITION)), F.lit((1 << POSITION) - 1))
            keyed = placed.join(axes, "node", "left").withColumn("key", F.shiftleft(position.cast("long"), HASH).bitwiseOR(_hash_bits(F.col("text_hash"), HASH))).drop("axis", "low", "span")
            found = _quantile(keyed, "key", goals)
            #: (key, tie): rows below go left; a tie of 0 sends the key's rows right, a tie over all sends them left.
            cuts, split = {}, {}
            for n, (key, below, at) in found.items():
                before, after = abs(goals[n] - below), abs(below + at - goals[n])
                cuts[n] = (key, 0 if before <= after else 1 << BITS)
                if min(before, after) > allowed:
                    split[n] = goals[n] - below
            if split:
                at_cut = values(spark, [(n, cuts[n][0]) for n in split], "node key")
                same = keyed.join(at_cut, ["node", "key"]).withColumn("tie", _hash_bits(F.col("id_hash"), BITS))
                for n, (tie, below, at) in _quantile(same.select("node", "tie", "size"), "tie", split).items():
                    cuts[n] = (cuts[n][0], tie if split[n] - below <= below + at - split[n] else tie + 1)
            moves = values(spark, [(n, k, t, n + leaves[n] // 2) for n, (k, t) in cuts.items()], "node cut cut_tie right")
            goes_right = (F.col("key") > F.col("cut")) | ((F.col("key") == F.col("cut")) & (_hash_bits(F.col("id_hash"), BITS) >= F.col("cut_tie")))
            placed = keyed.join(moves, "node", "left").withColumn("node", F.when(goes_right, F.col("right")).otherwise(F.col("node")))
            placed = materialize(placed.drop("key", "cut", "cut_tie", "right"))
        leaves = {m: k for n, had in leaves.items() for m, k in (((n, had // 2), (n + had // 2, had - had // 2)) if had > 1 else ((n, had),))}
    return placed


def with_slots(rows: DataFrame) -> DataFrame:
    """Number each node's rows from 0 without gaps: rows are numbered inside hashed parts of a
    node, and the parts' counts, summed up in order, say where each part begins."""
    total = rows.count()
    parts = max(64, total // SLOT_ROWS)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id_hash", "text_hash"), F.lit(parts)))
    counts = rows.groupBy("node", "part").agg(F.count("*").alias("n"))
    starts = counts.withColumn("start", F.sum("n").over(W.partitionBy("node").orderBy("part")) - F.col("n")).drop("n")
    inside = F.row_number().over(W.partitionBy("node", "part").orderBy("text_hash", "id_hash", "doc_id")) - 1
    return rows.withColumn("inside", inside).join(starts, ["node", "part"]).withColumn("slot", (F.col("start") + F.col("inside")).cast("long"))


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Shard (``node``) and slot of every document, for so many shards or leaves of so many bytes."""
    text = F.col("text")
    narrow = docs.select(
        "doc_id",
        *carry,
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        F.xxhash64(F.col("doc_id"), F.lit("id")).alias("id_hash"),
        *[c.cast("double").alias(n) for n, c in text_metadata(text).items()],
    )
    rows = materialize(narrow)
    if shards is None:
        shards = max(1, -(-(rows.agg(F.sum("size")).first()[0] or 1) // (target_bytes or 1 << 30)))
    return with_slots(kd_assign(rows, list(text_metadata(text)), shards))


def shard_documents(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``, which replace columns of those names. Rows get a number of their own first, as
    ids may repeat."""
    columns, number = [c for c in docs.columns if c.lower() not in ("shard", "slot")], unused([*docs.columns, "doc_id", "size"], "__row")
    full = materialize(docs.select(*columns, F.monotonically_increasing_id().alias(number)))
    placed = shard(full.select("doc_id", "text", number), shards, target_bytes, [number]).select(number, F.col("node").cast("int").alias("shard"), "slot")
    return full.join(placed, number).select(*columns, "shard", "slot")


def shard_report(docs: DataFrame, shards: int = 8) -> DataFrame:
    return shard(docs, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("node").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
