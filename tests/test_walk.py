"""What a walk moves and leaves on disk, and that numbers come back as they were."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import graph
from siltstone.sources.tables import cuts_folder


@pytest.mark.parametrize("kind", [np.float64, np.int64, np.int32])
def test_thin_numbers(kind):
    rng = np.random.default_rng(1)
    odd = [0.0, -0.0, np.inf, -np.inf, np.nan, 5e-324, 1.0, -1.5] if kind is np.float64 else [0, -1, np.iinfo(kind).max, np.iinfo(kind).min, 7]
    for x in (np.array([], kind), np.array(odd, kind), (rng.standard_normal(5000) * 1e6).astype(kind), np.sort(rng.integers(0, 1 << 20, 5000)).astype(kind)):
        assert graph._thick(graph._thin(x), kind).tobytes() == x.tobytes()


def _written(spark):
    folder = cuts_folder(spark).removeprefix("file:")
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, fs in os.walk(folder) for f in fs)


def _moved(spark):
    gateway = spark.sparkContext._gateway
    found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(found.apply(i).shuffleWriteBytes() + found.apply(i).diskBytesSpilled() for i in range(found.size()))


def test_walk_moves_and_leaves_little(spark):
    """Neighbours anywhere, in large groups: a step moves less than 8 bytes for each node and part that it has neighbours in, and only the last state stays; the walk is that of plain loops."""
    rng = np.random.default_rng(2)
    n, parts, steps = 20_000, 8, 6
    group, pairs = rng.integers(0, 4, n), np.unique(rng.integers(0, n, (100_000, 2)), axis=0)
    pairs = pairs[(pairs[:, 0] != pairs[:, 1]) & (group[pairs[:, 0]] != group[pairs[:, 1]])]
    pairs = np.unique(np.r_[pairs, pairs[:, ::-1]], axis=0)
    size = np.bincount(group)
    base = spark.createDataFrame([(i, int(group[i]), int(size[group[i]]) - 1, 0.2 if i < 5 else None) for i in range(n)], "node long, number long, many long, t double")
    nodes = graph.numbered(base, parts, "node")
    ids = nodes.select("id", "node").localCheckpoint()
    ends = spark.createDataFrame(pairs.tolist(), "src long, dst long").join(ids.toDF("from", "src"), "src").join(ids.toDF("to", "dst"), "dst").select("from", "to").localCheckpoint()
    moved, written = _moved(spark), _written(spark)
    got = {r["node"]: r["score"] for r in graph.flow(nodes, ends, parts, steps).join(ids, "id").select("node", F.col("score")).collect()}
    moved, written = _moved(spark) - moved, _written(spark) - written
    t = np.where(np.arange(n) < 5, 0.2, 0.0)
    deg = size[group] - 1 + np.bincount(pairs[:, 0], minlength=n)
    score = t
    for _ in range(steps):
        give = score / deg
        score = 0.15 * t + 0.85 * (np.bincount(group, weights=give)[group] - give + np.bincount(pairs[:, 1], weights=give[pairs[:, 0]], minlength=n))
    assert got.keys() == set(np.flatnonzero(score).tolist()) and all(got[i] == pytest.approx(score[i], rel=1e-9) for i in got)
    asked = len(np.unique(pairs[:, 0] * parts + pairs[:, 1] * parts // n))  # numbers of a step, about
    assert moved < 1.05 * 8 * asked * steps  # 0.88 times, with what is moved once; 1.23 before
    assert written < 2 * 8 * n  # 0.9 times; 6.5 before
