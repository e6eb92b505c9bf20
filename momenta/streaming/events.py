"""Structured Streaming: running moments by window of event time, and transition counts with a state for each user."""

from __future__ import annotations

import contextlib
import itertools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

LATE = "1 hour"


def moment_windows(events: DataFrame, window: str = "1 hour", late: str = LATE) -> DataFrame:
    """(start, event_type, n, mean, square): count, mean and mean square of value by window of ts; rows later than the watermark are left out."""
    v = F.col("value")
    sums = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.avg(v * v).alias("square"))
    return sums.select(F.col("window.start").alias("start"), "event_type", "n", "mean", "square")


def transitions(events: DataFrame) -> DataFrame:
    """(user_id, prev, cur, n) for each batch: pairs of following event types of a user, the last type kept from batch to batch.

    A batch's rows are put in order of ts and event_id within a user. Rows older than what a user's state has seen are
    late and left out; batches are expected in the order of time.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches).sort_values(["ts", "event_id"], kind="stable")
        last, seen = state.get if state.exists else (None, -1)
        rows = rows[rows["ts"].astype("int64") >= seen] if seen >= 0 else rows
        if len(rows):
            kinds = ([last] if last is not None else []) + rows["event_type"].tolist()
            pairs = pd.DataFrame({"prev": kinds[:-1], "cur": kinds[1:]}, dtype="object")
            state.update((kinds[-1], int(rows["ts"].astype("int64").max())))
            if len(pairs):
                counts = pairs.groupby(["prev", "cur"]).size().reset_index(name="n")
                yield counts.assign(user_id=key[0])[["user_id", "prev", "cur", "n"]]

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, prev string, cur string, n long", "last string, seen long", "append", "NoTimeout")


class _Last(StatefulProcessor):
    """The last event type of a user and when it was, until nothing has come for the idle time."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "last string, seen long, timer long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(rows).sort_values(["ts", "event_id"], kind="stable")
        ms = batch["ts"].astype("datetime64[us]").astype("int64") // 1000
        last, seen, timer = self.state.get() if self.state.exists() else (None, -1, None)
        fresh = (ms >= seen).to_numpy()
        kinds, times = [last, *batch["event_type"].to_numpy()[fresh]], [seen, *ms.to_numpy()[fresh].tolist()]
        pairs = [(a, b) for (a, b), (s, t) in zip(itertools.pairwise(kinds), itertools.pairwise(times), strict=True) if a is not None and t - s <= self.idle_ms]
        if len(kinds) > 1:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.state.update((kinds[-1], int(times[-1]), int(times[-1]) + self.idle_ms + 1))
            self.handle.registerTimer(int(times[-1]) + self.idle_ms + 1)
        if pairs:
            counts = pd.Series(pairs).value_counts()
            yield pd.DataFrame({"user_id": [key[0]] * len(counts), "prev": [a for a, _ in counts.index], "cur": [b for _, b in counts.index], "n": counts.to_numpy("int64")})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def expiring_transitions(events: DataFrame, idle: str = "7 days", late: str = LATE) -> DataFrame:
    """(user_id, prev, cur, n) for each batch: pairs of following event types of a user that are no more than `idle` apart.

    The last type of a user is kept from batch to batch and leaves the state store by an event-time timer as soon as the watermark
    has passed the idle time: nothing that comes then could make a pair with it, so what is counted doesn't depend on the batches. The state store
    is RocksDB's (run_to_table() names it).
    """
    ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    rows = events.withWatermark("ts", late).groupBy("user_id")
    return rows.transformWithStateInPandas(_Last(ms), "user_id long, prev string, cur string, n long", "Append", "eventTime")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def state_store(spark: SparkSession, provider: str | None) -> Iterator[None]:
    """Streams that start inside keep their state with this provider; None leaves the session's."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    if provider:
        spark.conf.set(name, provider)
    try:
        yield
    finally:
        if provider and before:
            spark.conf.set(name, before)
        elif provider:
            spark.conf.unset(name)


def run_to_table(df: DataFrame, mode: str, provider: str | None = None, on_end: Callable[[StreamingQuery], None] | None = None) -> DataFrame:
    """Runs a stream over all that is there now and returns what it wrote, as a table; on_end sees the ended stream (its progress, say)."""
    from momenta.sources.scratch import folder

    spark = df.sparkSession
    out = folder(spark, "stream")
    if mode == "append":
        with state_store(spark, provider):
            query = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out)
            query.awaitTermination()
        if on_end:
            on_end(query)
    else:
        # a complete result is written anew for each batch; the last one stays
        written: list[int] = []

        def keep(batch: DataFrame, n: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/{n}")
            written.append(n)

        query = df.writeStream.outputMode("complete").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).foreachBatch(keep).start()
        query.awaitTermination()
        out = f"{out}/{max(written)}"
    return spark.read.schema(df.schema).parquet(out)
