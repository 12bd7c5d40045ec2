"""Stored indexes: BM25 over segments against BM25 over the texts as they are now, the cell index against exact search, and what their plans read."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import dense, sparse
from siltstone.operators.memory import GraphMemory
from siltstone.operators.cells import CellIndex, k_means, nearest
from siltstone.operators.stored_sparse import SparseStore
from siltstone.sources.tables import table

WORDS = "ash birch cedar elm fir hazel larch maple oak pine rowan spruce willow yew".split()


def text(rnd, n):
    return " ".join(rnd.choices(WORDS, weights=range(1, len(WORDS) + 1), k=n))


def docs(spark, rows):
    return spark.createDataFrame(rows, "collection string, id long, text string")


def hits(df):
    return sorted((r["query_id"], r["collection"], r["id"], round(r["score"], 9), r["rank"]) for r in df.collect())


@pytest.fixture(scope="module")
def asks(spark):
    return spark.createDataFrame([(1, "oak pine oak"), (2, "yew"), (3, "unknown words only"), (4, ""), (5, "ash elm willow maple")], "query_id long, text string")


@pytest.fixture(scope="module")
def changes():
    """Base, three segments and deletes, and the texts that are left."""
    rnd = random.Random(4)
    make = lambda ids, c="x": [(c, i, text(rnd, rnd.randint(0, 30))) for i in ids]
    steps = [("add", make(range(120)) + make(range(30), "y") + [("x", 500, None), ("x", 501, "")]), ("add", make(range(100, 160))), ("remove", [("x", i, None) for i in range(0, 60, 7)] + [("z", 1, None), ("y", 999, None)]), ("add", make(range(0, 20, 2), "y") + [("x", 14, "yew yew oak")]), ("remove", [("y", 2, None)]), ("add", [("x", 700, "yew"), ("x", 700, "oak")])]
    now = {}
    for kind, rows in steps:
        for c, i, t in sorted(rows, key=lambda r: (r[0], r[1], r[2] or "")):
            if kind == "add":
                now[c, i] = t
            else:
                now.pop((c, i), None)
    return steps, [(c, i, t) for (c, i), t in now.items()]


def stored(spark, folder, steps):
    store = SparseStore(spark, folder, 8)
    for kind, rows in steps:
        df = docs(spark, rows)
        store.add(df) if kind == "add" else store.remove(df.select("collection", "id"))
    return store


def test_segments_equal_the_union(spark, tmp_path, asks, changes):
    steps, now = changes
    store = stored(spark, f"{tmp_path}/s", steps)
    want = hits(sparse.search(docs(spark, now), asks, 7))
    assert want and hits(store.search(asks, 7)) == want
    assert {(r["collection"], r["id"]) for r in store.documents().collect()} == {(c, i) for c, i, _ in now}
    stats = {r["collection"]: (r["n"], round(r["mean"], 9)) for r in store.statistics().collect()}
    sized = {c: [len((t or "").split()) for k, _, t in now if k == c] for c in ("x", "y")}
    assert stats == {c: (len(v), round(sum(v) / len(v), 9)) for c, v in sized.items()}
    before = store.table.version()
    store.compact()
    assert hits(store.search(asks, 7)) == want and len(store.table.manifest()["segments"]) == 3
    store.add(docs(spark, [("x", 1, "yew pine")]))
    later = [(c, i, t) for c, i, t in now if (c, i) != ("x", 1)] + [("x", 1, "yew pine")]
    assert hits(store.search(asks, 7)) == hits(sparse.search(docs(spark, later), asks, 7))
    assert hits(store.search(asks, 7, before)) == want  # an earlier version as it was


def test_only_folders_of_the_terms_are_read(spark, tmp_path, changes):
    store = stored(spark, f"{tmp_path}/s", changes[0][:2])
    terms = spark.createDataFrame([("oak",)], "term string")
    (bucket,) = [r[0] for r in terms.select(F.pmod(F.xxhash64("term"), F.lit(8))).collect()]
    plan = store.postings(terms)._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan or "PartitionFilters: [cast(bucket" in plan  # noqa: F541
    files = {f.split("/bucket=")[1].split("/")[0] for f in store.postings(terms).inputFiles() if "/bucket=" in f}
    read = store.table.tagged("postings", None, F.col("bucket").isin([int(bucket)]))
    assert {r["bucket"] for r in read.select("bucket").distinct().collect()} == {bucket} and files


def test_empty_store(spark, tmp_path, asks):
    store = SparseStore(spark, f"{tmp_path}/s")
    assert store.search(asks, 3).collect() == [] and store.compact() == 0
    store.remove(docs(spark, [("x", 1, None)]))
    assert store.search(asks, 3).collect() == []
    store.add(docs(spark, []))
    assert store.search(asks, 3).collect() == []


def recall(found, exact):
    want, got = {}, {}
    for rows, out in ((exact, want), (found, got)):
        for r in rows:
            out.setdefault(r["query_id"], set()).add(r["id"])
    return np.mean([len(want[q] & got.get(q, set())) / len(want[q]) for q in want])


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_of_the_cells(spark, tmp_path, folder):
    """0.95 of the ten nearest, with a quarter of the cells left out; all scores exact. These vectors point everywhere alike, which is as hard as can be (test_cells_are_pruned_and_rows_skipped has clusters)."""
    points = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    queries = points.where("id % 25 = 0").select(F.col("id").alias("query_id"), "vector")
    index = CellIndex(spark, f"{tmp_path}/c")
    index.create(points, cells=32, parts=8)
    found = index.search(queries, 10, probes=24, wide=20).collect()
    exact = dense.top(dense.scores(points, queries), 10).collect()
    assert recall(found, exact) >= 0.95
    scores = {(r["query_id"], r["id"]): r["score"] for r in exact}
    assert all(abs(scores[r["query_id"], r["id"]] - r["score"]) < 1e-9 for r in found if (r["query_id"], r["id"]) in scores)
    assert {r["rank"] for r in found} == set(range(1, 11))


def clusters(n, seed=1, width=16, centres=12):
    rnd = np.random.default_rng(seed)
    at = rnd.normal(size=(centres, width))
    return [(i, (at[i % centres] + 0.2 * rnd.normal(size=width)).tolist()) for i in range(n)]


def test_cells_are_pruned_and_rows_skipped(spark, tmp_path):
    rows = clusters(2400)
    index = CellIndex(spark, f"{tmp_path}/c")
    index.create(spark.createDataFrame(rows, "id long, vector array<double>"), cells=12, parts=4)
    queries = spark.createDataFrame([(0, rows[5][1])], "query_id long, vector array<double>")
    version = index.table.version()
    q = np.array(rows[5][1]) / np.linalg.norm(rows[5][1])
    model = index._model(version)
    cell = int(np.argmax(q @ model["centres"].T - (model["centres"] ** 2).sum(axis=1) / 2))
    near = index.rows([cell], version, "id", "code", "cell")
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and f"cell#" in plan  # noqa: F541
    assert 0 < near.count() <= 2400 / 4
    assert "v:array" not in plan  # codes are read, vectors are not
    exact = dense.top(dense.scores(spark.createDataFrame(rows, "id long, vector array<double>"), queries), 10).collect()
    assert recall(index.search(queries, 10, probes=2).collect(), exact) >= 0.9


def test_index_entries(spark, tmp_path):
    """Added, replaced and removed vectors; dimensions are checked; all cells and rows give exact search."""
    rows = clusters(300, seed=2)
    frame = lambda r: spark.createDataFrame(r, "id long, vector array<double>")
    index = CellIndex(spark, f"{tmp_path}/c")
    index.create(frame(rows + [(900, None), (901, [0.0] * 16), (None, [1.0] * 16)]), cells=4, parts=4)
    with pytest.raises(ValueError, match="dimension"):
        index.add(frame([(1000, [1.0] * 8)]))
    index.add(frame([(5, rows[7][1]), (400, rows[8][1])]))
    index.remove(spark.createDataFrame([(8,), (12345,)], "id long"))
    index.add(frame([(8, rows[9][1])]))
    index.remove(spark.createDataFrame([(20,)], "id long"))
    now = dict(rows) | {5: rows[7][1], 400: rows[8][1], 8: rows[9][1]}
    del now[20]
    queries = spark.createDataFrame([(i, rows[i][1]) for i in range(0, 300, 37)] + [(-1, [0.0] * 16)], "query_id long, vector array<double>")
    want = [(r["query_id"], r["id"], r["rank"], round(r["score"], 9)) for r in dense.top(dense.scores(frame(sorted(now.items())), queries), 6).collect()]
    got = [(r["query_id"], r["id"], r["rank"], round(r["score"], 9)) for r in index.search(queries, 6, probes=4, wide=100).collect()]
    assert sorted(got) == sorted(want)
    with pytest.raises(ValueError):
        CellIndex(spark, f"{tmp_path}/none").create(frame([]))


def test_k_means():
    x = np.concatenate([np.zeros((5, 2)), np.ones((5, 2)) * 9])
    centres = k_means(x, 2)
    assert sorted(map(tuple, centres)) == [(0, 0), (9, 9)]
    assert k_means(x[:1], 4).shape == (4, 2) and nearest(x, centres)[1].max() == 0


# Graph memory.
def mentions(n, seed, start=0):
    rnd = random.Random(seed)
    out = []
    for i in range(start, start + n):
        fact = min(rnd.randint(0, 60), rnd.randint(0, 60))
        out.append((i, f"s{fact % 7}" if rnd.random() > 0.1 else f"s{rnd.randint(0, 9)}", f"f{fact}", f"p{rnd.randint(0, 25)}"))
    return out


def state(memory):
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    return rows(memory.schemas()), rows(memory.facts()), rows(memory.links()), rows(memory.keys("passage"))


def test_two_builds_equal_one(spark, tmp_path):
    frame = lambda r: spark.createDataFrame(r, "seq long, schema string, fact string, passage string")
    one, two = GraphMemory(spark, f"{tmp_path}/one"), GraphMemory(spark, f"{tmp_path}/two")
    first, second = mentions(150, 1), mentions(250, 2, 150)
    one.merge(frame(first + second + [(999, None, "f", "p")]))
    assert two.merge(frame(first)) == 1
    half = state(two)
    assert two.merge(frame(second)) == 2
    assert state(two) == state(one)
    known = {k: i for i, k, *_ in half[1]}
    assert known == {k: i for i, k, *_ in state(two)[1] if k in known}  # numbers of the first build stay
    for layer in ("schema", "fact", "passage"):
        assert sorted(r["idx"] for r in two.keys(layer).collect()) == list(range(two.keys(layer).count()))
    assert sorted(tuple(r) for r in two.facts(1).collect()) == half[1]  # the first build, as it was
    by = {k: i for i, k, *_ in state(two)[1]}
    passages = {k: i for i, k in state(two)[3]}
    assert set(state(two)[2]) == {(by[f], passages[p]) for _, _, f, p in first + second}


def test_a_build_on_a_stale_version_is_worked_out_again(spark, tmp_path, monkeypatch):
    frame = lambda r: spark.createDataFrame(r, "seq long, schema string, fact string, passage string")
    memory, real, done = GraphMemory(spark, f"{tmp_path}/m"), GraphMemory._build, []

    def build(self, rows, now):
        if not done:
            done.append(1)
            GraphMemory(spark, f"{tmp_path}/m").merge(frame([(1, "s", "f0", "p")]))
        return real(self, rows, now)

    monkeypatch.setattr(GraphMemory, "_build", build)
    memory.merge(frame([(5, "s", "f1", "p"), (6, "t", "f0", "q")]))
    assert sorted((r["idx"], r["key"], r["mentions"], r["passages"]) for r in memory.facts().collect()) == [(0, "f0", 2, 2), (1, "f1", 1, 1)]
