"""Streams over several batches: state that expires and comes back, windows that close."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from momenta.streaming import events as stream

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"
START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def batches(spark, tmp_path_factory):
    """Four files, read one by one: user 1 pauses for two days, in which user 2 moves the watermark on."""
    at = lambda hours: START + dt.timedelta(hours=hours)
    parts = [
        [(1, at(0), 1, "a", 1.0), (2, at(1), 1, "b", 2.0), (3, at(1), 2, "a", 3.0)],
        [(4, at(2), 1, "c", 4.0), (5, at(20), 2, "b", 5.0)],
        [(6, at(40), 2, "c", 6.0)],
        [(7, at(50), 1, "a", 7.0), (8, at(51), 1, "b", 8.0), (9, at(52), 2, "a", 9.0)],
    ]
    folder = tmp_path_factory.mktemp("events")
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(folder / f"{n}"))
    return [r for p in parts for r in p], lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_state_expires_and_comes_back(spark, batches):
    rows, read = batches
    progress = []
    got = stream.run_to_table(stream.expiring_transitions(read(), "12 hours"), "append", stream.ROCKSDB, lambda q: progress.extend(q.recentProgress))
    pairs = sorted((r.user_id, r.prev, r.cur, r.n) for r in got.groupBy("user_id", "prev", "cur").agg(F.sum("n").alias("n")).collect())
    # 1: a b, b c, then two days later a b anew; 2: a (19 h) b (20 h) c (12 h) a: only the last pair is near enough
    assert pairs == [(1, "a", "b", 2), (1, "b", "c", 1), (2, "c", "a", 1)]
    held = [p.stateOperators[0].numRowsTotal for p in progress if p.stateOperators]
    assert max(held) > min(held[1:]) and any(p.stateOperators[0].numRowsRemoved for p in progress if p.stateOperators)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != stream.ROCKSDB


def test_windows_are_written_when_they_close(spark, batches):
    """In append mode a window comes once, when the watermark has passed it; the last ones stay open."""
    rows, read = batches
    got = {(r.start, r.event_type): r.n for r in stream.run_to_table(stream.moment_windows(read()), "append").collect()}
    closed = {(ts.replace(minute=0), kind) for _, ts, _, kind, _ in rows if ts < START + dt.timedelta(hours=51)}
    assert set(got) == closed and all(n == 1 for n in got.values())
