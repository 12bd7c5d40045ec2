"""Stalled and hidden rows, and examples by the latest record, in cases that the tables do not hold."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siltstone.operators import messages, queue

NOW = datetime(2024, 1, 1, 12)


@pytest.mark.parametrize("limit", [3600, 0, -1])
def test_stalled_and_shown(spark, limit):
    """Age is never below 0; a missing time is stalled and hidden; no limit, no stall and nothing hidden."""
    times = [None, datetime(2024, 1, 1, 10), datetime(2024, 1, 1, 11), datetime(2024, 1, 1, 11, 0, 1), datetime(2025, 1, 1)]
    rows = [(s, t) for s in ("running", "indexed", "pending", None) for t in times]
    df = spark.createDataFrame(rows, "status string, t timestamp")
    got = df.select("status", "t", queue.stalled(F.col("status"), F.col("t"), F.lit(NOW), limit).alias("stalled"), queue.shown(F.col("status"), F.col("t"), F.lit(NOW), limit).alias("shown"), queue.shown(F.col("status"), F.col("t"), F.lit(NOW), limit, True).alias("all")).collect()
    for r in got:
        old = limit > 0 and (r["t"] is None or max(0, (NOW - r["t"]).total_seconds()) > limit)
        assert r["stalled"] == (r["status"] == "running" and old) and r["shown"] == (not (r["status"] == "indexed" and old)) and r["all"]


def test_latest_examples(spark):
    m = lambda *xs: [{"role": r, "content": c} for r, c in xs]
    records = [
        ("c1", "t1", "2024-01-01", m(("user", "old")), {"role": "assistant", "content": "old"}),
        ("c1", "t2", "2024-01-02", m(("user", "a"), ("user", "a"), ("user", "b"), ("user", "a")), {"role": "assistant", "content": "z"}),
        ("c2", "t3", None, m(("user", "only")), None),
        ("", "t4", "1", m(("user", "q"), ("system", ""), (None, "x")), {"role": "assistant", "content": "r"}),
        (None, None, "1", m(("user", "n1")), {"role": "assistant", "content": "s"}),
        (None, "", "2", m(("user", "n2")), {"role": "assistant", "content": "s"}),
        ("c3", "t5", "1", None, {"role": "assistant", "content": "alone"}),
        ("c4", "t6", None, m(("user", "null time")), {"role": "assistant", "content": "s"}),
        ("c4", "t7", "0", m(("user", "later")), {"role": "assistant", "content": "s"}),
    ]
    kind = "struct<role:string,content:string>"
    df = spark.createDataFrame(records, f"conversation_id string, trace_id string, ts string, messages array<{kind}>, assistant {kind}")
    got = {tuple((x["role"], x["content"]) for x in r["messages"]): r["key"] for r in messages.latest_examples(df.repartition(3)).collect()}
    a = ("assistant", "s")
    assert set(got) == {(("user", "a"), ("user", "b"), ("user", "a"), ("assistant", "z")), (("user", "q"), ("assistant", "r")), (("user", "n1"), a), (("user", "n2"), a), (("user", "later"), a)}
    assert got[(("user", "a"), ("user", "b"), ("user", "a"), ("assistant", "z"))] == "c1" and got[(("user", "q"), ("assistant", "r"))] == "t4"
    assert messages.latest_examples(df.where("false")).collect() == []
