"""Streams with state of their own: sessions closed by timers, and a join of two streams under watermarks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.plans.session import shared_root

SESSION = "user_id bigint, start_ms bigint, last_ms bigint, n bigint, total double"
_OPEN = "start_ms bigint, last_ms bigint, n bigint, total double"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def merge_sessions(open_: list[tuple], gap_ms: int) -> list[tuple]:
    """Sessions (start, last, n, total), those closer than the gap as one."""
    out: list[tuple] = []
    for s in sorted(open_):
        if out and s[0] - out[-1][1] < gap_ms:
            a = out.pop()
            s = (a[0], max(a[1], s[1]), a[2] + s[2], a[3] + s[3])
        out.append(s)
    return out


class Sessions(StatefulProcessor):
    """A user's open sessions as state; a timer at the end of the first gap emits all whose gap has passed.

    Rows may come in any order within the watermark: a row between two open sessions
    joins them. Rows below the watermark never arrive here. A user's state is read and
    written once a batch, not once a session: there is always a timer at or before the
    first end, and it sets the next one.
    """

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", _OPEN)

    def _held(self) -> list[tuple]:
        return [tuple(r) for r in self.open.get()] if self.open.exists() else []

    def _first_end(self, sessions: list[tuple]) -> int:
        return min(s[1] for s in sessions) + self.gap_ms

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self._held()
        now = merge_sessions(held + [(ms, ms, 1, value or 0.0) for _, _, ms, value in rows], self.gap_ms)
        self.open.put(now)
        if not held or self._first_end(now) < self._first_end(held):
            self.handle.registerTimer(self._first_end(now))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Emits the sessions whose gap the watermark has passed; a timer of a session that has grown since may find none."""
        at, held = timerValues.getCurrentWatermarkInMs(), self._held()
        if left := [s for s in held if s[1] + self.gap_ms > at]:
            if len(left) < len(held):
                self.open.put(left)
            self.handle.registerTimer(self._first_end(left))
        elif held:
            self.open.clear()
        for s in held:
            if s[1] + self.gap_ms <= at:
                yield Row(user_id=key[0], start_ms=s[0], last_ms=s[1], n=s[2], total=s[3])

    def close(self) -> None:
        return None


def closed_sessions(events: DataFrame, gap_seconds: int, late: str) -> DataFrame:
    """Sessions of a stream (user_id, ts, value) that ended ``gap_seconds`` or more before the watermark."""
    marked = events.filter("user_id is not null and ts is not null").withWatermark("ts", late)
    rows = marked.select("user_id", "ts", F.unix_millis("ts").alias("ms"), F.col("value").cast("double").alias("value"))
    return rows.groupBy("user_id").transformWithState(statefulProcessor=Sessions(1000 * gap_seconds), outputStructType=SESSION, outputMode="Append", timeMode="EventTime")


def attributed(first: DataFrame, then: DataFrame, within: str, late: str) -> DataFrame:
    """Pairs of two streams (user_id, ts, event_id): a row of ``then`` up to ``within`` after one of ``first`` of the same user.

    The watermarks of both sides and the time bound tell Spark when a row's state can go.
    """
    a = first.select(F.col("user_id").alias("a_user"), F.col("ts").alias("a_ts"), F.col("event_id").alias("first_id")).withWatermark("a_ts", late)
    b = then.select("user_id", F.col("ts").alias("b_ts"), F.col("event_id").alias("then_id")).withWatermark("b_ts", late)
    bound = (F.col("a_user") == F.col("user_id")) & (F.col("b_ts") >= F.col("a_ts")) & (F.col("b_ts") <= F.col("a_ts") + F.expr(f"interval {within}"))
    return a.join(b, bound).select("user_id", "first_id", "then_id", "a_ts", "b_ts")


def run_available(spark: SparkSession, plan: Callable[[], DataFrame], path: str, checkpoint: str) -> None:
    """Appends what a stream has now to a Parquet table; a later call goes on from the checkpoint."""
    held = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        plan().writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, held)


def stream_to_table(spark: SparkSession, plan: Callable[[], DataFrame]) -> DataFrame:
    """The rows that a stream over files gives when all of them have been read, in the shared folder."""
    root = f"{shared_root(spark)}/streams/{uuid.uuid4().hex[:12]}"
    run_available(spark, plan, f"{root}/out", f"{root}/checkpoint")
    return spark.read.schema(plan().schema).parquet(f"{root}/out")


def from_millis(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, timezone.utc).replace(tzinfo=None)
