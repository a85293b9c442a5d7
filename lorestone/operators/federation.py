"""One search over the stores of many peers at once, with a time limit for each."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECONDS = 3.0


@dataclass(frozen=True)
class Answers:
    #: All peers' hits with ``server``, the best scores first; null if no peer gave any.
    hits: DataFrame | None
    unreachable: tuple[str, ...]


def fan_out(spark: SparkSession, peers: Mapping[str, Callable[[SparkSession], DataFrame]], seconds: float = SECONDS) -> Answers:
    """The rows of each peer's own limited search, which has a column ``score``. One job a peer, all started at once and tagged; after
    ``seconds`` the jobs of those that are still at work are interrupted. Slow and broken peers are unreachable, and the
    others' hits do not wait for them. Only searches with a limit belong here: their rows come to the driver.
    A peer whose tasks hang on all cores keeps the others waiting too."""
    found: dict[str, tuple[list, object]] = {}
    tags = {name: f"peer-{uuid.uuid4().hex}" for name in peers}

    def ask(name: str) -> None:
        spark.addTag(tags[name])
        try:
            hits = peers[name](spark)
            found[name] = (hits.collect(), hits.schema)
        except Exception:  # noqa: BLE001, S110  whatever it is, this peer has not answered
            pass

    threads = {name: InheritableThread(target=ask, args=(name,), daemon=True) for name in peers}
    until = time.monotonic() + seconds
    for t in threads.values():
        t.start()
    for t in threads.values():
        t.join(max(0.0, until - time.monotonic()))
    answered = dict(found)  # what comes later does not count
    for name in peers:
        if name not in answered:
            spark.interruptTag(tags[name])
    tables = [spark.createDataFrame(rows, schema).withColumn("server", F.lit(name)) for name, (rows, schema) in sorted(answered.items())]
    whole = None
    for t in tables:
        whole = t if whole is None else whole.unionByName(t, allowMissingColumns=True)
    if whole is not None:
        whole = whole.orderBy(F.desc("score"), "server")
    return Answers(whole, tuple(n for n in peers if n not in answered))
