"""Hard negatives by norm-bucketed search against brute force in whole numbers."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import norm_buckets as N

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
TYPES = "vec_id long, label int, embedding array<double>"
FITS = lambda x: max(-(1 << 63), min(x, (1 << 63) - 1))


def brute(rows, every=100, positives=5, negatives=10, low=30, high=90):
    ok = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(Fraction(x) * 256) for x in v]
        ok[i] = min(ok.get(i, (w, label)), (w, label))
    out = []
    for a, (va, la) in ok.items():
        if a % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(va, v, strict=False)), i, label) for i, (v, label) in ok.items() if i != a)
        for p, pid, _ in [s for s in scores if s[2] == la][:positives]:
            fits = [s for s in scores if s[2] != la and low * -p <= 100 * -s[0] <= high * -p][:negatives]
            out += [(a, pid, r + 1, i, FITS(-p), FITS(-s)) for r, (s, i, _) in enumerate(fits)]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def vectors(n, seed=1, width=6):
    """Norms that differ by orders of magnitude, ties, one very common vector, one hot label."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        size = 10 ** rnd.uniform(-1, 1.5)
        v = [rnd.gauss(0, 1) * size for _ in range(width)]
        if i % 5 == 0:
            v = [1.0, 0.5, -0.25, 0.0, 1.0, 2.0][:width]
        rows.append((i, 0 if i % 3 == 0 else rnd.randint(0, 4), v))
    return rows


def test_against_brute_force(spark):
    rows = vectors(1500)
    df = spark.createDataFrame(rows, TYPES).repartition(3)
    assert result(N.hard_negatives(df, F.col("vec_id") % 100 == 0)) == brute(rows)


def test_small_buckets_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BUCKET", 32)
    monkeypatch.setattr(N, "ANCHORS", 4)
    monkeypatch.setattr(N, "AT_ONCE", 3)
    rows = vectors(700, seed=3)
    df = spark.createDataFrame(rows, TYPES).repartition(5)
    got = result(N.hard_negatives(df, F.col("vec_id") % 50 == 0, positives=3, negatives=4, low=20, high=100))
    assert got == brute(rows, 50, 3, 4, 20, 100) and got


def test_odd_rows(spark):
    """Nulls everywhere, components that are not finite, vectors of other widths, repeated ids, scores of zero and below it, a label of its own, clashing names."""
    rows = vectors(300, seed=4)
    rows += [(1000, 0, None), (1001, None, [1.0] * 6), (None, 0, [9.0] * 6), (1100, 0, [1.0, None, 1.0]), (1200, 0, [float("nan")] * 6), (1300, 0, [float("inf")] * 6), (1400, 99, [1.0] * 6), (1500, 0, [0.0] * 6)]
    rows += [(1600, 1, [-1.0, -0.5]), (1700, 2, []), (1801, 1, [1.0] * 9), (100, 0, [1.0] * 6), (100, 0, [-1.0] * 6), (200, 4, rows[200][2])]
    df = spark.createDataFrame([(*r, "x", 1.5) for r in rows], f"{TYPES}, norm string, rank double").repartition(2)
    got = result(N.hard_negatives(df, F.col("vec_id") % 100 == 0))
    assert got == brute(rows)
    assert not {1000, 1001, 1100, 1200, 1300, 1400} & {r[0] for r in got}


def test_huge_values(spark):
    rows = [(i, i % 2, [(-1.0) ** i * 10.0 ** (i % 40 * 4), 1.0 + i]) for i in range(200)] + [(300, 1, [1e308, 1e308]), (301, 1, [1e308, 1.0]), (302, 0, [5e307, 2.0])]
    df = spark.createDataFrame(rows, TYPES)
    got = result(N.hard_negatives(df, F.col("vec_id") % 20 == 0))
    assert got == brute(rows, 20) and any(abs(r[4]) >= 1 << 62 for r in got)


def test_no_rows(spark):
    assert N.hard_negatives(spark.createDataFrame([], TYPES), F.col("vec_id") % 100 == 0).collect() == []
    assert N.hard_negatives(spark.createDataFrame([(1, 1, [1.0])], TYPES), F.col("vec_id") % 100 == 0).collect() == []
    assert N.hard_negatives(spark.createDataFrame([(0, 1, [1.0])], TYPES), F.col("vec_id") % 100 == 0).collect() == []


def test_buckets_are_left_out(monkeypatch):
    """Once the k-th score is beyond what the norms allow, no more is multiplied."""
    import pyarrow as pa

    done = []
    real = N.products
    monkeypatch.setattr(N, "products", lambda a, b: done.append(len(b)) or real(a, b))
    monkeypatch.setattr(N, "BUCKET", 10)
    norms = np.array(sorted((2.0 ** -(i // 10) for i in range(100)), reverse=True))
    batch = pa.RecordBatch.from_arrays([pa.array(norms), pa.array([1] * 100), pa.array(range(100)), pa.array([[x, 0.0] for x in norms])], names=["norm", "label", "vec_id", "v"])
    anchors = {"v": np.array([[1.0, 0.0]]), "id": np.array([1000]), "label": np.array([1]), "of": np.array([0]), "low": np.array([-np.inf]), "high": np.array([np.inf])}
    (out,) = N.scan(anchors, 5, True)(iter([batch]))
    assert out.column("vec_id").to_pylist() == [0, 1, 2, 3, 4] and done == [10]


def test_keys():
    numbers = [0, 1, -1, 15, 16, -16, 1 << 63, -(1 << 63), 1 << 700, -(1 << 700), 3, -3]
    assert sorted(numbers) == sorted(numbers, key=N.ordered) and all(N.number(N.ordered(x)) == x for x in numbers)


def test_limits_of_the_window():
    with pytest.raises(ValueError):
        N.hard_negatives(None, None, low=0)
