"""Connected components of a table of links, as joins and sums only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorestone.llm.common import materialize


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """``(node, component)`` for the nodes of ``links(a, b)``; a component is its smallest node.

    Each round takes the least label of the neighbours and then the label of that label, so paths
    shorten by half at least. Labels are written to the shared folder every round.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = materialize(both)
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    for _ in range(most_rounds):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        least = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("component").alias("was"), F.least("component", "near").alias("now"))
        target = labels.select(F.col("node").alias("t"), F.col("component").alias("jump"))
        new = materialize(least.join(target, F.col("now") == F.col("t")).select("node", "was", F.least("now", "jump").alias("component")))
        moved = new.filter("was <> component").limit(1).count()
        labels = new.select("node", "component")
        if not moved:
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
