"""What tasks keep of the scores that they make: the same rows as from all scored rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from siltstone.operators import dense, sparse
from siltstone.operators.best import best


def shown(df):
    return sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in df.collect())


def test_best_keeps_what_can_be_among_the_first():
    rng = np.random.default_rng(3)
    slot, score = rng.integers(0, 5, 3000), rng.integers(0, 12, 3000) / 7 + rng.integers(0, 3, 3000) * 1e-10
    score[::50] = np.nan
    ident = rng.permutation(3000)
    kept = best(slot, score, ident, 7)
    first = lambda at, s: sorted((i for i in at if slot[i] == s), key=lambda i: (-np.inf if np.isnan(score[i]) else -round(score[i], 9), ident[i]))[:7]
    assert all(first(range(3000), s) == first(kept, s) for s in range(5)) and len(kept) < 400
    assert len(best(np.zeros(0, int), np.zeros(0), np.zeros(0, int), 3)) == 0


def test_bm25_scan_equals_joined_rows(spark, monkeypatch):
    """Copies, ties, null ids and collections, empty texts, repeated query terms; a few documents at a time."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(25)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(rng.choice(["a", "b", None]), i if i % 90 else None, text(rng.randrange(30))) for i in range(400)] + [("a", 1000 + i, "w1 w2 w3 w3") for i in range(60)] + [("b", 2000, None), ("b", 3, "w1")]
    found, stats = sparse.index(spark.createDataFrame(docs, "collection string, id long, text string").repartition(5))
    wanted = sparse.query_terms(spark.createDataFrame([(i, text(8)) for i in range(9)] + [(20, "w1 w2 w3 w3"), (21, "nothing"), (22, "w5 w5 w5 w6")], "query_id long, text string"))
    monkeypatch.setattr(sparse, "CELLS", 100)
    got = sparse.ranked(found, stats, wanted, 6)
    assert shown(got.select("query_id", "collection", "id", "score", "rank")) == shown(sparse.ranked(found, stats, wanted, 6, most_weights=0).select("query_id", "collection", "id", "score", "rank"))
    assert got.where(F.col("query_id") == 20).count() == 12


def test_nearest_and_all_pairs_equal_spark_expressions(spark, monkeypatch):
    """Copies in plenty, vectors of other sizes, null, empty, zero, with null, NaN and infinite components, null ids; parts and blocks of a few."""
    rng = random.Random(6)
    vector = lambda n=6: [rng.gauss(0, 1) for _ in range(n)]
    same, nan = vector(), float("nan")
    rows = [(i, vector()) for i in range(300)] + [(300 + i, same) for i in range(150)] + [(500, None), (501, []), (502, [0.0] * 6), (503, [None] + vector(5)), (504, [nan] + vector(5)), (505, [float("inf")] + vector(5)), (None, vector()), (507, vector(3))]
    points = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    asks = points.where("id % 7 = 0 OR id > 495").select(F.col("id").cast("int").alias("query_id"), "vector")
    text = lambda df: df.withColumn("id", F.struct("id"))  # noqa: E731  ids that take the other way, and sort alike
    for name, value in (("PART", 90), ("SIDE", 70), ("MOST_QUERIES", 20), ("CELLS", 1000)):
        monkeypatch.setattr(dense, name, value)
    assert shown(dense.scores(points, asks).select("query_id", "id", "score")) == shown(dense.scores(text(points), asks).select("query_id", "id.id", "score"))
    want = dense.top(dense.scores(text(points), asks), 9).select("query_id", "id.id", "score", "rank")
    assert shown(dense.nearest(points, asks, 9).select("query_id", "id", "score", "rank")) == shown(want)


def test_nearest_sorts_few_scores(monkeypatch):
    """Points of a part are met some at a time and the first bound the later ones; before, all scores of a part were sorted for each query."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    sorted_, plain = [], np.partition
    monkeypatch.setattr(dense, "TILE", 500)
    monkeypatch.setattr(np, "partition", lambda x, *a, **k: sorted_.append(x.size) or plain(x, *a, **k))
    table = lambda first, x: pa.table({"id": np.arange(first, first + len(x)), "v": pa.array(x.tolist())})
    x, y = rng.standard_normal((5000, 16)), rng.standard_normal((40, 16))
    x[900:1000], x[4000:4050] = x[4100:4200], x[17] * 3
    y[3], x[30, 2], x[40], y[5] = x[17], np.nan, 1e-170, y[5] * 1e200
    got = dense._met(table(0, x), table(0, y), 7).to_pandas()
    with np.errstate(all="ignore"):
        cos = (y @ x.T) / (np.linalg.norm(y, axis=1)[:, None] * np.linalg.norm(x, axis=1))
    for q in set(range(40)) - {5}:
        mine = got[got.query_id == q]
        assert 30 in set(mine.id)
        ranked = lambda ids, s: [i for _, i in sorted((-round(v, 9), i) for i, v in zip(ids, s) if i not in (30, 40))][:6]  # noqa: E731  NaN comes before them
        assert ranked(mine.id, cos[q][mine.id]) == ranked(range(5000), cos[q])
    assert sum(sorted_) <= 40 * 500


def test_quantised_takes_bounds_once(spark):
    """The bounds of a vector stand once in the plan; before, they were taken again for each component."""
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(50)] + [(50, [2.0] * 8), (51, []), (52, None)]
    index = dense.quantised(spark.createDataFrame(rows, "id long, vector array<double>"))
    plan = index.select("id", "codes")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_min") == 1
    for (i, v), got in zip(rows[:51], index.orderBy("id").collect(), strict=True):
        step = (max(v) - min(v)) / 15
        assert tuple(got) == (i, min(v), step, [int((x - min(v)) / step + 0.5) if step else 0 for x in v])


def test_all_scores_rounded_as_spark_does(spark):
    """Half up in shortest decimal form, in the task; before, Spark rounded each row of all pairs."""
    rng = np.random.default_rng(11)
    x = np.r_[rng.uniform(-1, 1, 20_000), rng.integers(-(10**7), 10**7, 20_000) / 1e7, rng.integers(-(10**8), 10**8, 2000) / 1e7 + 1e-16, [0.0, -0.0, -1e-9, 5e-7, -5e-7, 4.9999999e-7, 1e300, -1.5, 123456789.1234565, 12345.0000005, np.inf, -np.inf, np.nan]]
    want = [r["y"] for r in spark.createDataFrame(x.tolist(), "double").select(F.round("value", 6).alias("y")).collect()]
    assert [repr(v) for v in dense.rounded(x, 6).tolist()] == [repr(v) for v in want]
    v = lambda n: rng.integers(-3, 4, (n, 4)).astype(float).tolist()
    points = spark.createDataFrame(list(enumerate(v(300) + [[0.0] * 4, [1.0], [float("nan")] * 4])), "id long, vector array<double>")
    asks = spark.createDataFrame(list(enumerate(v(40))), "query_id long, vector array<double>")
    rows = lambda df: sorted(repr(tuple(r)) for r in df.select("query_id", "id", "score").collect())
    plain = dense.scores(points, asks).withColumn("score", F.round("score", 6))
    assert rows(dense.scores(points, asks, digits=6)) == rows(plain)
    assert rows(dense.scores(points, asks.select(F.col("query_id").cast("string"), "vector"), digits=6)) == rows(plain.withColumn("query_id", F.col("query_id").cast("string")))
