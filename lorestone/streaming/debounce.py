"""Bursts of changes as state of each path: a burst is given out by a timer once nothing has followed it for the gap.

Event time rules: bursts do not depend on how rows are spread over micro-batches, on restarts or on order within the allowed
lateness, and are those that ``watch.bursts`` finds in the whole table. The state needs Spark's RocksDB store (``SETTINGS``)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a session must be set to before such a query starts.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Began, last change, number, and the last change's content, of the bursts that are open; times in milliseconds.
_STATE = "began array<bigint>, last array<bigint>, changes array<bigint>, content_hash array<string>"


class _Bursts(StatefulProcessor):
    def __init__(self, gap: int) -> None:
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getValueState("open", _STATE)

    def _held(self) -> list[tuple]:
        return [*zip(*self.open.get(), strict=True)] if self.open.exists() else []

    def _hold(self, bursts: list[tuple]) -> None:
        if bursts:
            self.open.update(tuple(list(c) for c in zip(*bursts, strict=True)))
        else:
            self.open.clear()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self._held()
        timed = {b[1] + self.gap for b in held}
        for batch in rows:
            held += [(t, t, 1, h) for t, h in zip(batch["ms"].tolist(), batch["content_hash"].tolist(), strict=True)]
        merged: list[tuple] = []
        for began, last, n, content in sorted(held, key=lambda b: b[:2]):
            if merged and began - merged[-1][1] <= self.gap:
                b = merged[-1]
                merged[-1] = (b[0], max(b[1], last), b[2] + n, content if last >= b[1] else b[3])
            else:
                merged.append((began, last, n, content))
        self._hold(merged)
        due = {b[1] + self.gap for b in merged}
        for t in timed - due:
            self.handle.deleteTimer(t)
        for t in due - timed:
            self.handle.registerTimer(t)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until = expiredTimerInfo.getExpiryTimeInMs()
        held = self._held()
        over = [b for b in held if b[1] + self.gap <= until]
        self._hold([b for b in held if b[1] + self.gap > until])
        if over:
            yield pd.DataFrame([(key[0], b[0], b[1] + self.gap, b[2], b[3]) for b in over], columns=["path", "began_ms", "ended_ms", "changes", "content_hash"])


def debounced(events: DataFrame, gap_ms: int = 2000, late: str = "10 seconds") -> DataFrame:
    """``(path, began, ended, changes, content_hash)`` of the stream ``events(path, ts, content_hash)``: each burst once, with what its last change left."""
    rows = events.select("path", "ts", F.unix_millis("ts").alias("ms"), "content_hash").withWatermark("ts", late)
    schema = "path string, began_ms bigint, ended_ms bigint, changes bigint, content_hash string"
    out = rows.groupBy("path").transformWithStateInPandas(_Bursts(gap_ms), schema, "append", "EventTime")
    return out.select("path", F.timestamp_millis("began_ms").alias("began"), F.timestamp_millis("ended_ms").alias("ended"), "changes", "content_hash")
