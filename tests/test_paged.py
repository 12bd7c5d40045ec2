"""The paged source and the upsert that halves."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from siltstone.sources import paged


@pytest.fixture(scope="module")
def source(spark):
    paged.register(spark)


def points(n):
    rnd = random.Random(1)
    return [(i, rnd.choice(["a", "b", None]), [rnd.random(), float(i)] if i % 11 else None, json.dumps({"at": i})) for i in range(n)]


@pytest.fixture
def folder(spark, tmp_path, source):
    path = f"{tmp_path}/c"
    spark.createDataFrame(points(5000), paged.SCHEMA).repartitionByRange(4, "id").write.format("paged").mode("append").save(path)
    return path


def rows(df):
    return sorted((r["id"], r["source"], r["vector"], json.loads(r["payload"])["at"]) for r in df.collect())


def expected(keep=lambda i, s: True, n=5000):
    return [(i, s, v, json.loads(p)["at"]) for i, s, v, p in points(n) if keep(i, s)]


def test_reads_what_was_written(spark, folder):
    df = spark.read.format("paged").load(folder)
    assert rows(df) == expected() and df.rdd.getNumPartitions() == 2


def test_filters_are_done_where_pages_are_read(spark, folder):
    read = spark.read.format("paged").load(folder)
    assert rows(read.where("id >= 1200 AND id < 1300 AND source = 'a'")) == expected(lambda i, s: 1200 <= i < 1300 and s == "a")
    assert rows(read.where("id IN (7, 4999, 80000)")) == expected(lambda i, s: i in (7, 4999))
    assert rows(read.where("source IN ('a', 'b') AND id <= 20")) == expected(lambda i, s: s and i <= 20)
    assert rows(read.where("size(vector) = 2 AND id > 4900")) == [r for r in expected(lambda i, s: i > 4900) if r[2]]
    reader = paged.PagedReader({"path": folder})
    left = list(reader.pushFilters([paged.GreaterThanOrEqual(("id",), 1200), paged.LessThan(("id",), 1300), paged.EqualTo(("source",), "a"), paged.EqualTo(("payload",), "x")]))
    assert [f.attribute for f in left] == [("payload",)]
    read = [f for p in reader.partitions() for f in p.files]
    assert len(read) <= 2 < len(paged.index_of(folder)["pages"])  # the pages of that range alone


def test_cap_and_dimension(spark, folder):
    df = spark.read.format("paged").option("max_points", 700).load(folder)
    assert rows(df) == expected(lambda i, s: i < 700)
    assert rows(spark.read.format("paged").option("dim", 2).load(folder)) == [r for r in expected() if r[2]]
    assert spark.read.format("paged").option("dim", 3).load(folder).count() == 0


def test_a_write_that_fails_leaves_the_collection_as_it_was(spark, folder):
    bad = spark.createDataFrame([(i, "x", None, "{}" if i != 900 else "{broken") for i in range(1000)], paged.SCHEMA).repartition(3)
    with pytest.raises(Exception):
        bad.write.format("paged").mode("append").save(folder)
    assert rows(spark.read.format("paged").load(folder)) == expected()
    spark.createDataFrame([(9000, "z", [1.0, 2.0], '{"at": 1}')], paged.SCHEMA).write.format("paged").mode("append").save(folder)
    assert rows(spark.read.format("paged").load(folder))[-1] == (9000, "z", [1.0, 2.0], 1)
    spark.createDataFrame([(1, "z", [1.0, 2.0], '{"at": 1}')], paged.SCHEMA).write.format("paged").mode("overwrite").save(folder)
    assert rows(spark.read.format("paged").load(folder)) == [(1, "z", [1.0, 2.0], 1)]


def test_nothing_there(spark, tmp_path, source):
    assert spark.read.format("paged").load(f"{tmp_path}/none").collect() == []


def test_named_vectors():
    assert paged.vector_of({"vector": {"a": [], "b": [1, 2]}}) == [1.0, 2.0] and paged.vector_of({"vector": {"a": "x"}}) is None and paged.vector_of({}) is None


class Store:
    """A folder that takes batches: refuses those with a negative id, and is away for those with an odd one the first times."""

    def __init__(self, folder, away=0):
        self.folder, self.away = folder, away

    def __call__(self, points):
        if self.away:
            self.away -= 1
            raise ConnectionError("away")
        if any(p["id"] < 0 for p in points):
            raise paged.Refused("negative id")
        for p in points:
            with open(f"{self.folder}/{p['id']}", "w") as f:
                json.dump(p, f)


def test_one_bad_row_of_ten_thousand_costs_one_row(spark, tmp_path):
    df = spark.range(10_000).select(F.when(F.col("id") == 4321, -1).otherwise(F.col("id")).alias("id"), F.array(F.lit(1.0)).alias("vector")).repartition(4)
    paged.upsert(df, Store(str(tmp_path)), batch=500).write.parquet(f"{tmp_path}-quarantine")
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}-quarantine").collect()] == [(-1, [1.0], "negative id")]
    assert {int(f) for f in os.listdir(tmp_path)} == set(range(10_000)) - {4321}


def test_retries_and_halves():
    waited, calls = [], []

    def put(points):
        calls.append(len(points))
        if len(calls) <= 2:
            raise TimeoutError("slow")
        if 13 in [p["id"] for p in points]:
            raise ConnectionError("reset")

    bad = paged.put_all([{"id": i} for i in range(16)], put, retries=2, backoff=0.5, wait=waited.append)
    assert bad == [({"id": 13}, "ConnectionError: reset")]
    assert calls[:3] == [16, 16, 16] and waited[:2] == [0.5, 1.0]
    with pytest.raises(ZeroDivisionError):
        paged.put_all([{"id": 1}], lambda p: 1 / 0)
    assert paged.put_all([], None) == []
