"""State with timers against the batch forms over the same events, restarts and disorder included."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from siltstone.streaming import events as ev
from siltstone.streaming import timers

BASE = datetime(2024, 1, 1, tzinfo=timezone.utc)
TYPES = "event_id long, ts timestamp, user_id long, status string"
END = [(10**6, BASE + timedelta(days=400), 0, "done")]


def some(n=240, seed=1, users=4):
    rnd = random.Random(seed)
    rows = [(i, BASE + timedelta(seconds=rnd.choice([rnd.randint(0, 3000), 60 * rnd.randint(0, 50)])), rnd.randint(1, users), rnd.choice(["running", "running", "done"])) for i in range(n)]
    return sorted(rows, key=lambda r: r[1])


def run(spark, tmp_path, name, processor, files, what=None):
    """Each list of files is one run of the query; a stopped query goes on from its checkpoint."""
    for part in files:
        for rows in part:
            spark.createDataFrame(rows, TYPES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}-in")
        stream = spark.readStream.schema(TYPES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}-in")
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", timers.PROVIDER)
        timers.run_timed(spark, timers.timed(stream, processor, "600 seconds", "user_id", "ts", "event_id", what), f"{tmp_path}/{name}-out", f"{tmp_path}/{name}-check").awaitTermination()
    return spark.read.parquet(f"{tmp_path}/{name}-out")


@pytest.fixture(scope="module")
def data(spark):
    """Events in time order, cut in two runs; rows of each file are shuffled and some are exchanged with the next file, within the watermark."""
    rows = some()
    mixed = rows[:]
    for i in range(0, len(mixed) - 8, 9):
        mixed[i], mixed[i + 7] = mixed[i + 7], mixed[i]
    half = len(rows) // 2
    return rows, [[mixed[:half]], [mixed[half:], END]]


def test_sessions(spark, tmp_path, data):
    rows, files = data
    got = run(spark, tmp_path, "s", timers.Sessions(90), files)
    want = ev.sessions(spark.createDataFrame(rows, TYPES), 90).select("user_id", "n", "seconds")
    assert sorted((r["key"], r["n"], r["seconds"]) for r in got.where("key <> 0").collect()) == sorted(tuple(r) for r in want.collect())


def test_failures(spark, tmp_path, data):
    rows, files = data
    got = run(spark, tmp_path, "f", timers.Failures(120, 3), files)
    want = ev.sliding_counts(spark.createDataFrame(rows, TYPES), 120, 3)
    # Rows of one time see each other in the batch form; in the stream the count grows from one to the next.
    last = lambda df, u, i: {(r[u], r["ts"]): r["n"] for r in df.join(spark.createDataFrame(rows, TYPES).select(F.col("event_id").alias("e"), "ts"), F.col(i) == F.col("e")).groupBy(u, "ts").agg(F.max("n").alias("n")).collect()}
    assert got.where("key <> 0").count() == len(rows)
    assert last(got.where("key <> 0"), "key", "id") == last(want, "user_id", "event_id")
    assert all(r["locked"] == (r["n"] >= 3) for r in got.collect())


def test_stalls(spark, tmp_path, data):
    rows, files = data
    got = run(spark, tmp_path, "j", timers.Stalls(100), files, "status")
    want, by = [], {}
    for i, ts, u, status in sorted(rows, key=lambda r: (r[1], r[0])):
        since = by.get(u)
        if since and (ts - since).total_seconds() > 100:
            want.append((u, since.replace(tzinfo=None)))
        by[u] = ts if status == "running" else None
    want += [(u, since.replace(tzinfo=None)) for u, since in by.items() if since]
    assert sorted((r["key"], r["at"]) for r in got.collect()) == sorted(want)
