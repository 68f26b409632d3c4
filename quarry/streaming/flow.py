"""The action log as a stream: tail it, count by window, follow the state graph."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarry.sources.readers import EVENT

STEP = ["operation_id", "from_state", "to_state", "is_legal"]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def tail_events(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.readStream.schema(EVENT).json(path)
    return rows.filter("_corrupt_record is null").withColumn("event_time", F.try_to_timestamp("event_time_utc"))


def windowed_counts(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events by window and action; later than ``late`` is dropped."""
    return events.withWatermark("event_time", late).groupBy(F.window("event_time", width), "action").count()


class Flow(StatefulProcessor):
    """Follows one operation through the state graph; events wait until the watermark says that none before them can come.

    ``waiting`` holds the status of each event that waits, by its place in the log;
    ``last`` the status that the operation is in.  Each time of an event has
    a timer, and so has the end of the silence after which an operation is forgotten.
    """

    def __init__(self, legal: set[tuple[str, str]], idle_ms: int):
        self.legal, self.idle_ms = legal, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "seq bigint", "at bigint, status string")
        self.last = handle.getValueState("last", "status string, at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        for part in rows:
            for seq, time, status in zip(part["seq"], part["event_time"], part["status"]):
                at = int(time.timestamp() * 1000)
                self.waiting.updateValue((int(seq),), (at, status))
                self.handle.registerTimer(at)
        yield pd.DataFrame(columns=STEP)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        now = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted((seq[0], at, status) for seq, (at, status) in self.waiting.iterator() if at <= now)
        last = self.last.get() if self.last.exists() else None
        steps = []
        for seq, at, status in due:
            if last is not None and at - last[1] < self.idle_ms:
                steps.append((key[0], last[0], status, (last[0], status) in self.legal))
            last = (status, at)
            self.waiting.removeKey((seq,))
        if due:
            self.last.update(last)
            self.handle.registerTimer(last[1] + self.idle_ms)
        elif last is not None and now >= last[1] + self.idle_ms:
            self.last.clear()
        yield pd.DataFrame(steps, columns=STEP)

    def close(self) -> None:
        pass


def follow_flow(events: DataFrame, legal: set[tuple[str, str]], late: str = "30 minutes", idle_ms: int = 7 * 86_400_000) -> DataFrame:
    """operation_id, from_state, to_state, is_legal of each step of a stream with operation_id, seq, event_time and status.

    The steps are those of the batch query, however the stream is cut and in
    whatever order events come, if none is later than ``late``: an event is told
    once the watermark has passed it, in order of ``seq``, which is that of the
    times.  After ``idle_ms`` of silence an operation is forgotten, and its next
    event begins anew.  Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    rows = events.select("operation_id", "seq", "event_time", "status").withWatermark("event_time", late)
    schema = "operation_id string, from_state string, to_state string, is_legal boolean"
    return rows.groupBy("operation_id").transformWithStateInPandas(Flow(legal, idle_ms), schema, "Append", "EventTime")
