"""Keyed state with the processor API: the document that holds for a reviewer, and tasks whose heartbeat stopped.

Both need the RocksDB state store; :func:`use_rocksdb` names it for a session that names none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOLDS = "reviewer long, segment long, holds string, n long"
FATE = "task_id string, status string, heartbeat_ms long"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class HeldDocument(StatefulProcessor):
    """ST1, ST2: per reviewer the latest segment, its last accepted document and how many rows came.

    Parsed documents are taken over, all other outcomes keep the one before; a later segment begins without a document.  Rows of a
    batch may come in any order: of what came only the latest segment's last accepted row matters, so nothing else is held.
    """

    def init(self, handle) -> None:
        self.state = handle.getValueState("held", "segment long, ix long, document string, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        segment, ix, document, n = self.state.get() if self.state.exists() else (None, None, None, 0)
        for part in rows:
            n += len(part)
            latest = int(part["segment"].max())
            if segment is None or latest > segment:
                segment, ix, document = latest, None, None
            accepted = part[(part["segment"] == segment) & (part["outcome"] == "parsed")]
            if len(accepted):
                last = accepted.loc[accepted["ix"].idxmax()]
                if ix is None or int(last["ix"]) > ix:
                    ix, document = int(last["ix"]), last["document"]
        self.state.update((segment, ix, document, n))
        yield pd.DataFrame({"reviewer": [key[0]], "segment": [segment], "holds": [document], "n": [n]})

    def close(self) -> None:
        pass


def held_documents(rows: DataFrame) -> DataFrame:
    """A stream (reviewer, segment, ix, outcome, document) as updates (reviewer, segment, holds, n)."""
    use_rocksdb(rows.sparkSession)
    return rows.groupBy("reviewer").transformWithStateInPandas(HeldDocument(), HOLDS, "Update", "None")


class Heartbeats(StatefulProcessor):
    """ST4: a running task is interrupted once time has passed its last heartbeat by the threshold."""

    def __init__(self, threshold_ms: int):
        self.threshold = threshold_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("task", "status string, heartbeat_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, beat = self.state.get() if self.state.exists() else (None, -1)
        for part in rows:
            last = part.sort_values(["heartbeat_ms", "status"], kind="stable").iloc[-1]
            if int(last["heartbeat_ms"]) >= beat:
                status, beat = str(last["status"]), int(last["heartbeat_ms"])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if status == "running":
            self.handle.registerTimer(beat + self.threshold)
        self.state.update((status, beat))
        yield pd.DataFrame({"task_id": [key[0]], "status": [status], "heartbeat_ms": [beat]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, beat = self.state.get()
        if status == "running":
            self.state.update(("interrupted", beat))
            yield pd.DataFrame({"task_id": [key[0]], "status": ["interrupted"], "heartbeat_ms": [beat]})

    def close(self) -> None:
        pass


def task_fates(beats: DataFrame, threshold_seconds: int = 300, time_mode: str = "ProcessingTime") -> DataFrame:
    """A stream (task_id, status, heartbeat_ms) as updates of each task's status; with ``time_mode`` EventTime the stream's watermark is the clock."""
    use_rocksdb(beats.sparkSession)
    return beats.groupBy("task_id").transformWithStateInPandas(Heartbeats(threshold_seconds * 1000), FATE, "Update", time_mode)
