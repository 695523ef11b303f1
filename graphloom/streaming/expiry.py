"""Locks that open by themselves: a state per task with an event-time timer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from graphloom.sources.scratch import fresh_path

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Locks(StatefulProcessor):
    """The lock of one task. A claim takes or renews it, an end frees it, and after ``minutes`` without either it expires."""

    def __init__(self, minutes: int) -> None:
        self.micros = minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.claimed = handle.getValueState("claimed", "at bigint")

    def _timer(self, at: int) -> int:
        """The first millisecond at which a lock claimed at ``at`` is older than the limit."""
        return (at + self.micros) // 1000 + 1

    def _ended(self, key: tuple, rows: list[tuple[int, int, str]]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame([(key[0], *r) for r in rows], columns=["id", "claimed_us", "ended_us", "reason"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = sorted(pair for frame in rows for pair in zip(frame["at"].tolist(), frame["finished"].tolist(), strict=True))
        before = self.claimed.get()
        held = before[0] if before else None
        ended = []
        for at, finished in events:
            if held is not None and at > held + self.micros:
                ended.append((held, held + self.micros, "expired"))
                held = None
            if finished and held is not None:
                ended.append((held, at, "finished"))
            held = None if finished else at
        if before:
            self.handle.deleteTimer(self._timer(before[0]))
            self.claimed.clear()
        if held is not None:
            self.claimed.update((held,))
            self.handle.registerTimer(self._timer(held))
        yield from self._ended(key, ended)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.claimed.get()[0]
        self.claimed.clear()
        yield from self._ended(key, [(held, held + self.micros, "expired")])

    def close(self) -> None:
        pass


def lock_ends(events: DataFrame, late: str = "1 hour", minutes: int = 30) -> DataFrame:
    """A stream of (id, claimed_at, ended_at, reason) of the locks that end, from a stream of (id, ts, finished).

    ``reason`` is 'finished', or 'expired' where nothing came for more than ``minutes``
    after the last claim; that needs no further event of the task, only event time. A
    claim of a held lock renews it, an end of a free one does nothing, a claim comes
    before an end of the same time. Rows with a null are left out, rows later than
    ``late`` too. A task's events of one micro-batch are sorted in memory: bound a batch
    by the files per trigger.
    """
    rows = events.na.drop(subset=["id", "ts", "finished"]).select("id", "ts", F.unix_micros("ts").alias("at"), "finished").withWatermark("ts", late)
    key = events.schema["id"].dataType.simpleString()
    ended = rows.groupBy("id").transformWithStateInPandas(Locks(minutes), f"id {key}, claimed_us bigint, ended_us bigint, reason string", "append", "EventTime")
    return ended.select("id", F.timestamp_micros("claimed_us").alias("claimed_at"), F.timestamp_micros("ended_us").alias("ended_at"), "reason")


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """What a stream gives for all that is there now, written to the shared folder; state is kept in RocksDB."""
    spark: SparkSession = stream.sparkSession
    path, before = fresh_path(spark, name), spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", fresh_path(spark, f"{name}-state")).trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
