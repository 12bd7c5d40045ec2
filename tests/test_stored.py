"""Versioned and keyed tables, incremental ingest, running sums and as-of joins: stops, stale writers, changed files, hot keys."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import chunking, ordered
from siltstone.sources.tables import corpus_records
from siltstone.sources.versioned import KeyedTable, Stale, Versioned
from siltstone.streaming import ingest


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "id string, v array<double>")


def ids(table, version=None):
    return {r["id"]: list(r["v"]) for r in table.current(version).collect()}


def test_commit_on_a_stale_version(spark, tmp_path):
    table = Versioned(spark, f"{tmp_path}/t")
    assert table.version() == 0 and table.manifest()["segments"] == []
    name = table.write(spark.range(3), "a")
    assert table.commit(0, [{"name": name, "kind": "base"}], {"by": "one"}) == 1
    with pytest.raises(Stale):
        table.commit(0, [{"name": "other", "kind": "base"}])
    assert table.manifest()["notes"] == {"by": "one"} and table.read(name).count() == 3
    assert not [f for f in os.listdir(tmp_path / "t/versions") if f.startswith(".") and not f.endswith(".crc")]


def test_rebuild_is_invisible_until_commit(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", "id")
    table.add(rows(spark, [("old", [1.0])]))
    rebuild = table.rebuild().stage(rows(spark, [("new", [2.0])]))
    assert ids(table) == {"old": [1.0]}
    before = table.version()
    rebuild.commit()
    assert ids(table) == {"new": [2.0]} and ids(table, before) == {"old": [1.0]}


def test_aborted_rebuild(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", "id")
    table.add(rows(spark, [("old", [1.0])]))
    rebuild = table.rebuild().stage(rows(spark, [("new", [2.0])]))
    rebuild.abort()
    assert ids(table) == {"old": [1.0]}
    with pytest.raises(ValueError):
        rebuild.commit()


def test_writes_between_stage_and_commit(spark, tmp_path):
    """What was added or removed meanwhile is neither lost nor back."""
    table = KeyedTable(spark, f"{tmp_path}/t", "id")
    table.add(rows(spark, [("a", [1.0]), ("b", [1.0]), ("c", [1.0])]))
    rebuild = table.rebuild().stage(rows(spark, [("a", [1.0]), ("b", [1.0])]))
    table.add(rows(spark, [("live", [3.0]), ("a", [9.0])]))
    rebuild.stage(rows(spark, [("c", [1.0]), ("b", [2.0])]))
    table.remove(rows(spark, [("c", [])]))
    table.add(rows(spark, [("back", [4.0])]))
    table.remove(rows(spark, [("back", [])]))
    rebuild.commit()
    assert ids(table) == {"a": [9.0], "b": [2.0], "live": [3.0]}
    table.add(rows(spark, [("c", [5.0])]))
    assert ids(table) == {"a": [9.0], "b": [2.0], "live": [3.0], "c": [5.0]}
    now = ids(table)
    table.compact()
    assert ids(table) == now and [s["kind"] for s in table.manifest()["segments"]] == ["base"]
    table.vacuum(1)
    assert ids(table) == now


def test_second_rebuild_and_stale_writer(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", "id")
    table.add(rows(spark, [("a", [1.0])]))
    one, two = table.rebuild().stage(rows(spark, [("one", [1.0])])), table.rebuild().stage(rows(spark, [("two", [2.0])]))
    seen = table.version()
    one.commit()
    with pytest.raises(Stale):
        two.commit()
    with pytest.raises(Stale):
        table.add(rows(spark, [("x", [0.0])]), at=seen)
    assert ids(table) == {"one": [1.0]}


def test_commit_takes_an_entry_along_that_comes_at_the_last_moment(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, f"{tmp_path}/t", "id")
    table.add(rows(spark, [("a", [1.0])]))
    rebuild = table.rebuild().stage(rows(spark, [("b", [1.0])]))
    real, tried = table.commit, []

    def commit(base, segments, notes=None):
        if not tried:
            tried.append(1)
            KeyedTable(spark, f"{tmp_path}/t", "id").add(rows(spark, [("late", [7.0])]))
        return real(base, segments, notes)

    monkeypatch.setattr(table, "commit", commit)
    rebuild.commit()
    assert ids(table) == {"b": [1.0], "late": [7.0]}


def test_keyed_table_odd_rows(spark, tmp_path):
    """Nothing yet, null keys, keys that repeat, only removals, only keys as columns."""
    table = KeyedTable(spark, f"{tmp_path}/t", "id")
    assert table.current() is None and table.compact() == 0
    table.remove(rows(spark, [("a", [])]))
    assert table.current() is None
    table.add(rows(spark, [("a", [1.0]), ("a", [3.0]), ("a", [2.0]), (None, [9.0])]))
    assert ids(table) == {"a": [3.0]}
    table.add(rows(spark, []))
    assert ids(table) == {"a": [3.0]}
    bare = KeyedTable(spark, f"{tmp_path}/bare", "id")
    bare.add(spark.createDataFrame([(1,), (1,), (2,)], "id int"))
    bare.remove(spark.createDataFrame([(2,)], "id int"))
    assert [r["id"] for r in bare.current().collect()] == [1]


# Incremental ingest.
TEXT = "First sentence here. Second one follows!\n\nA new paragraph. " * 40


def deliver(inbox, name, files):
    for path, content in files.items():
        target = inbox / name / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(content if isinstance(content, str) else "\n".join(x if isinstance(x, str) else json.dumps(x) for x in content))


def run(spark, tmp_path, **options):
    q = ingest.stream_ingest(spark, f"{tmp_path}/inbox", f"{tmp_path}/table", f"{tmp_path}/checkpoint", **options)
    q.awaitTermination()
    return ingest.ChunkTable(spark, f"{tmp_path}/table")


def found(table):
    return sorted((r["path"], r["chunk_idx"], r["title"], r["chunk"], r["point_id"]) for r in table.chunks().collect())


def at_once(spark, tmp_path, files):
    """What one ingest of these files gives, by the batch operator alone."""
    corpus = [p for p in files if p.endswith(".jsonl")]
    out = []
    texts = [(p, "text", 0, c, p.rsplit("/", 1)[-1].rsplit(".", 1)[0].replace("_", " ").title(), "") for p, c in files.items() if p not in corpus]
    for p in corpus:
        folder = tmp_path / f"once-{random.random()}"
        folder.mkdir()
        (folder / "corpus.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in files[p]))
        for i, r in enumerate(corpus_records(spark, str(folder)).orderBy("doc_id").collect()):
            texts.append((p, "corpus_jsonl", i, r["text"], r["title"], r["chunk_prefix"] or ""))
    df = spark.createDataFrame(texts, "path string, kind string, part long, text string, title string, prefix string")
    for r in chunking.ingest(df).collect():
        out.append((r["path"], r["chunk_idx"], r["title"], r["chunk"], r["point_id"]))
    return sorted(out)


def corpus(n, word="alpha"):
    return [{"doc_id": f"{i:04d}", "title": f"T{i}", "text": f"{word} {i} " * 300, "chunk_prefix": f"P{i}"} for i in range(n)]


def test_stream_equals_batch_and_changes_replace(spark, tmp_path):
    first = {"a/one_note.txt": TEXT, "two.md": "# Head\n\n" + TEXT, "corpus_x.jsonl": [*corpus(12)[:5], "{broken", "", {"doc_id": "n", "title": "none"}, *corpus(12)[5:]], "empty.txt": "\n", "skip.bin": "zz"}
    deliver(tmp_path / "inbox", "001", first)
    table = run(spark, tmp_path, per_trigger=2)
    known = {p: c for p, c in first.items() if p != "skip.bin"}
    assert found(table) == at_once(spark, tmp_path, known)
    states = {r["path"]: r for r in table.files().collect()}
    assert set(states) == set(known) and states["empty.txt"]["n_chunks"] == 0 and states["two.md"]["n_chunks"] == sum(r[0] == "two.md" for r in found(table))
    # A file that changed leaves no old chunk, one that became empty has none, a new one comes in; all others stay.
    second = {"a/one_note.txt": "Short now.", "two.md": " \n", "corpus_x.jsonl": corpus(3, "beta"), "b/new.txt": TEXT[:500]}
    deliver(tmp_path / "inbox", "002", second)
    table = run(spark, tmp_path)
    now = known | second
    assert found(table) == at_once(spark, tmp_path, now)
    table.forget(spark.createDataFrame([("b/new.txt",)], "path string"))
    del now["b/new.txt"]
    assert found(table) == at_once(spark, tmp_path, now)
    version = table.compact()
    assert found(table) == at_once(spark, tmp_path, now) and len(table.table.manifest(version)["segments"]) == 2
    deliver(tmp_path / "inbox", "003", {"b/new.txt": "back again"})
    assert found(run(spark, tmp_path)) == at_once(spark, tmp_path, now | {"b/new.txt": "back again"})


@pytest.mark.parametrize("stop", ["before chunks", "before commit", "after commit"])
def test_stopped_anywhere_and_started_again(spark, tmp_path, monkeypatch, stop):
    files = {"one.txt": TEXT, "corpus_y.jsonl": corpus(6)}
    deliver(tmp_path / "inbox", "001", files)
    monkeypatch.setattr(ingest.ChunkTable, "_stopped", False, raising=False)
    name = {"before chunks": "ingest", "before commit": "_commit", "after commit": "_commit"}[stop]
    real = getattr(ingest.ChunkTable, name)

    def broken(self, *args, **kw):
        if not ingest.ChunkTable._stopped:
            ingest.ChunkTable._stopped = True
            if stop == "after commit":
                real(self, *args, **kw)
            raise RuntimeError("killed")
        return real(self, *args, **kw)

    monkeypatch.setattr(ingest.ChunkTable, name, broken)
    with pytest.raises(Exception, match="killed"):
        run(spark, tmp_path)
    table = ingest.ChunkTable(spark, f"{tmp_path}/table")
    assert (table.chunks() is not None) == (stop == "after commit")
    table = run(spark, tmp_path)
    assert found(table) == at_once(spark, tmp_path, files)
    assert sum(s["kind"] == "chunks" for s in table.table.manifest()["segments"]) == 1


def test_a_batch_counts_once(spark, tmp_path):
    table = ingest.ChunkTable(spark, f"{tmp_path}/t")
    part = lambda text: spark.createDataFrame([("a.txt", "text", 0, text, "A", "", "d", 1)], "path string, kind string, part long, text string, title string, prefix string, delivery string, size long")
    assert table.ingest(part("one"), "s", 0) and not table.ingest(part("two"), "s", 0) and [r["chunk"] for r in table.chunks().collect()] == ["one"]
    assert table.ingest(part("three"), "other", 0) and [r["chunk"] for r in table.chunks().collect()] == ["three"]


# Running sums, numbers, last values, as-of joins.
def hot(n=3000, seed=1):
    """A key with most rows, a null key, small keys; order is unique."""
    rnd = random.Random(seed)
    out = [(None if i % 50 == 0 else "hot" if i % 10 else f"k{i % 70}", i, rnd.randint(-5, 9)) for i in range(n)]
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("parts", [1, 2, 13])
def test_running_sums(spark, parts):
    data = hot()
    got = {r["i"]: (r["k"], r["v"], r["total"], r["seen"], r["nth"]) for r in ordered.before(spark.createDataFrame(data, "k string, i long, v int"), ["k"], [F.col("i").asc()], {"total": F.col("v"), "nth": F.lit(1)}, {"seen": F.when(F.col("v") > 7, F.col("i"))}, parts).collect()}
    total, seen, nth = {}, {}, {}
    for k, i, v in sorted(data, key=lambda r: r[1]):
        assert got[i] == (k, v, total.get(k, 0), seen.get(k), nth.get(k, 0))
        total[k], nth[k] = total.get(k, 0) + v, nth.get(k, 0) + 1
        seen[k] = i if v > 7 else seen.get(k)
    assert len(got) == len(data)


def test_hot_key_is_in_many_parts(spark):
    """The plan's windows are over key and part, and a key with 90 % of the rows is in nearly all parts."""
    data = [("hot" if i % 10 else "cold", i) for i in range(4000)]
    rows = spark.createDataFrame(data, "k string, i long").repartitionByRange(8, "k", "i").withColumn("p", F.spark_partition_id())
    assert rows.where("k = 'hot'").select("p").distinct().count() >= 7
    out = ordered.numbered(spark.createDataFrame(data, "k string, i long"), ["k"], [F.col("i").asc()], parts=8)
    plan = out._jdf.queryExecution().toString()
    assert "windowspecdefinition(k#" in plan and "_part#" in plan
    assert {(r["k"], r["nth"]) for r in out.collect()} == {("hot", n + 1) for n in range(3600)} | {("cold", n + 1) for n in range(400)}


def test_running_without_keys_or_rows(spark):
    df = spark.range(100).select(F.col("id").alias("i"))
    got = ordered.numbered(df.repartition(5), [], [F.col("i").desc()], parts=4)
    assert sorted((r["nth"], r["i"]) for r in got.collect()) == [(n + 1, 99 - n) for n in range(100)]
    assert ordered.numbered(df.where("i < 0"), ["i"], [F.col("i").asc()]).collect() == []


def test_as_of(spark):
    rnd = random.Random(2)
    left = [(i, "hot" if i % 6 else None, None if i % 41 == 0 else rnd.randint(0, 400) / 4) for i in range(500)] + [(7, "x", 3.0)]
    right = [("hot" if i % 5 else rnd.choice([None, "x", "y"]), None if i % 37 == 0 else rnd.randint(0, 400) / 4, None if i % 4 == 0 else i, i) for i in range(400)]
    got = ordered.as_of(spark.createDataFrame(left, "i int, k string, t double"), spark.createDataFrame(right, "k string, t double, a int, b int"), ["k"], "t", ["a", "b"], parts=5)
    want = []
    for i, k, t in left:
        best = max(((rt, (a is not None, a or 0), b, a) for rk, rt, a, b in right if rk == k and rt is not None and t is not None and rt <= t), default=None)
        want.append((i, k, t, best[3] if best else None, best[2] if best else None))
    assert sorted(map(repr, [tuple(r) for r in got.collect()])) == sorted(map(repr, want))


def test_spaced(spark):
    rnd = random.Random(3)
    data = [("hot" if i % 8 else None if i % 3 else "b", rnd.randint(0, 900) / 2, i) for i in range(600)] + [("c", i * 0.4, i) for i in range(300)] + [("d", None, 1)]
    got = sorted(map(repr, [tuple(r) for r in ordered.spaced(spark.createDataFrame(data, "k string, t double, v int"), ["k"], "t", 4.8).collect()]))
    want, last = [], {}
    for k, t, v in sorted((r for r in data if r[1] is not None), key=lambda r: (str(r[0]), r[1], r[2])):
        if k not in last or t - last[k] >= 4.8:
            want.append((k, t, v))
            last[k] = t
    assert got == sorted(map(repr, want))
