"""Small literal cases of the operators' meaning."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import context, dense, fusion, graph, html, sparse
from siltstone.operators import text as op
from siltstone.plans import corpus_queries
from siltstone.sources import tables
from siltstone.streaming import events as ev


def values(spark, *columns):
    return spark.range(1).select(*columns).first()


def ranked(spark, names, by=1):
    return spark.createDataFrame([(by, n, i + 1) for i, n in enumerate(names)], "query_id int, id string, rank int")


def test_fusion_scores_and_order(spark):
    rows = fusion.fuse([(ranked(spark, ["x", "y"]), 0.7), (ranked(spark, ["y", "z"]), 0.3)], 10).orderBy("rank").collect()
    assert [r["id"] for r in rows] == ["y", "x", "z"]
    assert [r["fused"] for r in rows] == pytest.approx([0.7 / 62 + 0.3 / 61, 0.7 / 61, 0.3 / 62])
    first = lambda a, b: fusion.fuse([(ranked(spark, ["a"]), a), (ranked(spark, ["b"]), b)], 1).first()["id"]
    assert (first(0.9, 0.1), first(0.1, 0.9), first(0.5, 0.5), first(0, 0.5)) == ("a", "b", "a", "b")


def test_reserve(spark):
    fused = ranked(spark, [f"d{i}" for i in range(5)])
    got = [r["id"] for r in fusion.reserve(fused, ranked(spark, ["sparse-only"]), 5).orderBy("slot").collect()]
    assert got == ["d0", "d1", "d2", "d3", "sparse-only"]
    assert [r["id"] for r in fusion.reserve(fused, ranked(spark, ["s"]), 1).collect()] == ["s"]
    assert fusion.reserve(fused, ranked(spark, []), 3).count() == 3


def test_bm25(spark):
    docs = spark.createDataFrame([("c", "a", "python asyncio tutorial"), ("c", "b", "rust ownership basics"), ("c", "c", "python asyncio patterns"), ("c", "d", "baking sourdough bread"), ("c", "e", None)], "collection string, id string, text string")
    ask = lambda q, k: [(r["id"], r["score"]) for r in sparse.search(docs, spark.createDataFrame([(1, q)], "query_id int, text string"), k).orderBy("rank").collect()]
    assert {i for i, _ in ask("python asyncio", 2)} == {"a", "c"}
    assert [i for i, _ in ask("tutorial", 5)] == ["a"] and ask("tutorial", 5)[0][1] > 0
    assert ask("the and of", 5) == []


def test_dense_threshold_after_top_k(spark):
    points = spark.createDataFrame([(i, [1.0 if j == i else 0.5 if j == 0 else 0.0 for j in range(4)]) for i in range(4)] + [(9, [0.0] * 4), (8, [1.0])], "id long, vector array<double>")
    hits = dense.top(dense.scores(points, points.where("id = 0").select(F.col("id").alias("query_id"), "vector")), 3)
    assert hits.count() == 3 and hits.where("score > 0.9").count() == 1
    assert {r["id"] for r in hits.collect()} <= {0, 1, 2, 3}


def test_journal(spark):
    log = spark.createDataFrame([(1, "add", "a", 1), (2, "remove", "a", 0), (3, "add", "b", 2), (4, "add", "c", 3), (5, "add", "c", 4)], "seq int, op string, id string, vector int")
    assert {(r["id"], r["vector"]) for r in dense.replay(log).collect()} == {("b", 2), ("c", 4)}


def test_context(spark):
    hits = spark.createDataFrame([("q", 1, "short"), ("q", 2, "short and much longer detail"), ("q", 3, "short  "), ("r", 4, "short")], "query_id string, id long, text string")
    assert {r["id"] for r in context.dedupe(hits, ["query_id"]).collect()} == {2, 3, 4}
    assert {r["id"] for r in context.drop_contained(hits.where("id < 3 OR id = 4"), ["query_id"]).collect()} == {2, 4}
    rows = spark.createDataFrame([(1, "ERROR: disk full on /dev/sda"), (2, "filler " * 200)], "id long, text string").agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("h"))
    kept = rows.select(context.fit(F.col("h"), F.lit(120)).alias("k")).first()["k"]
    assert kept[0]["text"].startswith("ERROR") and len(kept) == 2 and len(kept[1]["text"]) == 120 - 28 - 8
    assert rows.select(context.fit(F.col("h"), F.lit(0)).alias("k")).first()["k"] == []


def test_gate_and_rewrite(spark):
    skip = lambda q, h=None: values(spark, op.skips_retrieval(F.lit(q), F.lit(h).cast("string")).alias("x"))["x"]
    assert skip("hello") and skip("ok") and skip("") and skip("what is it?", "off")
    assert not skip("hello?") and not skip("hi", "force") and not skip("thanks for the docker hint") and not skip("hello " + "x" * 80)
    re_ = lambda q: values(spark, op.rewrite(F.lit(q)).alias("x"))["x"]
    assert re_("k8s pod scheduling") == "kubernetes pod scheduling"
    assert "192.168.1.36" in re_("fix v1.2.3 on 192.168.1.36 /etc/app/config")
    assert re_("k8s") == "k8s"


def test_small_pieces_and_markers(spark):
    merged = lambda p, a, b: values(spark, op.merge_small(F.array(*map(F.lit, p)), a, b).alias("x"))["x"]
    assert merged(["a b", "c", "d e f"], 3, 10) == ["a b\n\nc", "d e f"]
    assert merged(["a b", "c"], 3, 2) == ["a b", "c"] and merged(["a"], 3, 9) == ["a"] and merged(["a", "b"], 0, 9) == ["a", "b"]
    book = f"x\n{op.BOOK_START[0]} T ***\nBody\n{op.BOOK_END[0]} T ***\ny"
    assert values(spark, op.between_markers(F.lit(book)).alias("x"))["x"] == "Body"


def test_sizes(spark):
    assert values(spark, op.parse_size(F.lit("1.2 KiB")).alias("x"))["x"] == int(1.2 * 1024)
    assert values(spark, op.parse_size(F.lit("-")).alias("x"))["x"] is None
    assert [values(spark, op.format_size(F.lit(n)).alias("x"))["x"] for n in (5, 2048, 3 * 1024**2)] == ["5 B", "2.0 KB", "3.0 MB"]


def test_sanitizer():
    long = "word " * 40
    assert html.sanitize(f"<nav>menu</nav><p>{long}</p><script>x</script>", "", "u")["text"] == long.strip()
    assert html.sanitize(f"<p>{long}</p>", "Category:X", "")["text"] is None
    assert html.sanitize("<p>tiny</p>", "", "")["text"] is None and html.sanitize(None, "", "")["text"] is None
    got = html.sanitize(f"<div class='_content'><p>{long}</p></div><p>tail</p>", "", "")
    assert got["root"] == "._content" and "tail" not in got["text"]
    wiki = html.sanitize(f"<p>{long}</p><h2>References</h2><p>ref one</p>", "", "/wiki/X")["text"]
    assert "ref one" not in wiki and "ref one" in html.sanitize(f"<p>{long}</p><h2>References</h2><p>ref one</p>", "", "/x")["text"]


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b", "uses"), ("b", "c", "uses"), ("c", "a", "uses")], "src string, dst string, rel string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert graph.walk(edges, seeds, 1).count() == 1 and graph.walk(edges, seeds, 2).count() == 2 and graph.walk(edges, seeds, 9).count() == 3
    passages = spark.createDataFrame([(1,), (2,)], "passage int")
    links = spark.createDataFrame([("f1", 1), ("f1", 2), ("f2", 1)], "fact string, passage int")
    facts = spark.createDataFrame([("f1", "s"), ("f2", "s")], "fact string, schema string")
    p, f, s = graph.prune(passages, links, facts, spark.createDataFrame([(1,)], "passage int"))
    assert (p.count(), [r["fact"] for r in f.collect()], s.count()) == (1, ["f1"], 1)
    p, f, s = graph.prune(passages, links, facts, passages)
    assert (p.count(), f.count(), s.count()) == (0, 0, 0)


def brute_pagerank(pairs, seeds, steps):
    nodes = sorted({x for p in pairs for x in p})
    out = {n: [b for a, b in pairs if a == n] for n in nodes}
    total = sum(seeds.values())
    t = {n: seeds.get(n, 0) / total for n in nodes}
    score = dict(t)
    for _ in range(steps):
        lost = sum(score[n] for n in nodes if not out[n]) / len(nodes)
        score = {n: 0.15 * t[n] + 0.85 * sum(score[m] / len(out[m]) for m in nodes if n in out[m]) + lost for n in nodes}
    return score


def test_pagerank(spark):
    pairs = {(f"n{i}", f"n{(i * 7 + k) % 30}") for i in range(25) for k in (1, 3, 4)}
    seeds = {"n1": 2.0, "n5": 1.0, "gone": 1.0}
    weights = spark.createDataFrame(list(seeds.items()), "node string, weight double")
    got = {r["node"]: r["score"] for r in graph.pagerank(spark.createDataFrame(list(pairs), "src string, dst string"), weights, steps=5, least=0.0).collect()}
    want = {n: s for n, s in brute_pagerank(pairs, seeds, 5).items() if s > 0}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)


def test_pagerank_of_groups(spark):
    """Groups stand for all pairs of their members, and degrees agree."""
    schema = {f"f{i:02d}": f"s{i % 5}" for i in range(23)} | {"alone": "own"}
    members = [(f"f{i:02d}", (i * i + k) % 9) for i in range(23) for k in (0, 2)]
    pairs = {(a, b) for a in schema for b in schema if a != b and (schema[a] == schema[b] or {p for f, p in members if f == a} & {p for f, p in members if f == b})}
    facts, rows = spark.createDataFrame(list(schema.items()), "fact string, schema string"), spark.createDataFrame(members, "fact string, passage int")
    found = graph.links(facts, rows)
    assert {(r["src"], r["degree"], r["first"]) for r in graph.degrees(facts, found).collect()} == {(n, sum(a == n for a, _ in pairs), min(b for a, b in pairs if a == n)) for n in {a for a, _ in pairs}}
    seeds = {"f01": 3.0, "f07": 1.0}
    got = {r["node"]: r["score"] for r in graph.pagerank(found, spark.createDataFrame(list(seeds.items()), "node string, weight double"), steps=4, least=0.0, groups=facts.toDF("node", "g")).collect()}
    want = {n: s for n, s in brute_pagerank(pairs, seeds, 4).items() if s > 0}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)


def test_pagerank_moves_no_pairs(spark):
    """A step moves a number for a node and part, not pairs; before, what flowed along every pair was shuffled in each step."""
    import numpy as np

    rng = np.random.default_rng(3)
    n = 2000
    a, b = rng.integers(0, n, 100_000), rng.integers(0, n - 20, 100_000)
    a, b = a[(a != b) & (a % 97 != 5)], b[(a != b) & (a % 97 != 5)]  # some nodes give nothing on, some get nothing
    group = np.where(np.arange(n) % 3 == 0, np.arange(n) % 7, -1 - np.arange(n))
    names = spark.range(n).selectExpr("id AS i", "concat('node ', id) AS name")
    ends = spark.createDataFrame(np.stack([np.r_[a, a[:500]], np.r_[b, b[:500]]], axis=1).tolist(), "a long, b long")  # 500 of them twice
    pairs = tables.cut(ends.join(names.toDF("a", "src"), "a").join(names.toDF("b", "dst"), "b").select("src", "dst"))
    groups = tables.cut(spark.createDataFrame(list(enumerate(group.tolist())), "i long, g long").where("g >= 0").join(names, "i").select(F.col("name").alias("node"), "g"))
    seeds = spark.createDataFrame([("node 4", 2.0), ("node 6", 1.0), ("no node", 1.0)], "node string, weight double")
    store = lambda: sum(s.shuffleWriteBytes() + s.diskBytesSpilled() for s in _stages(spark))
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for large tables
    try:
        moved = {}
        for steps in (2, 6):
            before = store()
            got = {r["node"]: r["score"] for r in graph.pagerank(pairs, seeds, steps, least=0.0, groups=groups).collect()}
            moved[steps] = store() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    linked = np.zeros((n, n))
    linked[a, b] = 1
    many = group[:, None] == group[None, :]
    given = linked + (many & ~np.eye(n, dtype=bool))
    deg, present = given.sum(1), (given.sum(1) > 0) | (given.sum(0) > 0)
    t = np.where(np.arange(n) == 4, 0.5, np.where(np.arange(n) == 6, 0.25, 0.0))
    score = t
    for _ in range(6):
        score = np.where(present, 0.15 * t + 0.85 * (given.T @ np.divide(score, deg, out=np.zeros(n), where=deg > 0)) + score[deg == 0].sum() / present.sum(), 0)
    assert got.keys() == {f"node {i}" for i in np.flatnonzero(score > 0)} and all(got[f"node {i}"] == pytest.approx(score[i], rel=1e-9) for i in np.flatnonzero(score > 0))
    assert (moved[6] - moved[2]) / 4 < 4 * len(a)


def test_pagerank_writes_sums_of_a_step(spark):
    """Between written steps only the sums of groups are written, and nothing stays persisted; before, each step wrote the scores and all that moves."""
    import numpy as np

    rng = np.random.default_rng(7)
    n = 5000
    a, b = rng.integers(0, n, (2, 20_000))
    a, b = a[a != b], b[a != b]
    pairs = tables.cut(spark.createDataFrame(np.stack([a, b], axis=1).tolist(), "src long, dst long"))
    seeds = spark.createDataFrame([(4, 1.0), (9, 2.0)], "node long, weight double")
    groups = spark.range(n).where("id % 3 = 0").selectExpr("id AS node", "id % 11 AS g")
    stored = lambda: sum(s.outputBytes() for s in _stages(spark))
    kept, wrote = spark.sparkContext._jsc.getPersistentRDDs().size(), {}
    for steps in (6, 10):
        before = stored()
        got = {r["node"]: r["score"] for r in graph.pagerank(pairs, seeds, steps, least=0.0, groups=groups).collect()}
        wrote[steps] = stored() - before
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == kept
    given = np.zeros((n, n))
    given[a, b] = 1
    group = np.where(np.arange(n) % 3 == 0, np.arange(n) % 11, -1 - np.arange(n))
    given += (group[:, None] == group[None, :]) & ~np.eye(n, dtype=bool)
    deg = given.sum(1)
    present = (deg > 0) | (given.sum(0) > 0)
    t = np.where(np.arange(n) == 4, 1 / 3, np.where(np.arange(n) == 9, 2 / 3, 0.0))
    score = t
    for _ in range(10):
        score = np.where(present, 0.15 * t + 0.85 * (np.divide(score, deg, out=np.zeros(n), where=deg > 0) @ given) + score[deg == 0].sum() / present.sum(), 0)
    assert got.keys() == set(np.flatnonzero(score > 0).tolist()) and all(got[i] == pytest.approx(score[i], rel=1e-9) for i in got)
    assert (wrote[10] - wrote[6]) / 4 < 8 * n


def test_seeds_by_name(spark):
    nodes = spark.createDataFrame([(i, f"Node {i % 3}") for i in range(40)], "id int, name string")
    got = graph.seeds_by_name(nodes, spark.createDataFrame([("node 1",), ("none",), ("node 1",)], "word string"), 4).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["id"])] == [1, 4, 7, 10]


def test_names_that_hold_words(spark):
    """All pairs, compared one by one; short and empty words, null, names that repeat and many words of one beginning."""
    rng = random.Random(4)
    names = [None, "", "Ab", "A"] + ["".join(rng.choice("abcAé 🙂") for _ in range(rng.randrange(12))) for _ in range(300)] + ["same name"] * 40
    words = ["", "a", "ab", "zz", "same", "same name", "é", "🙂", None] + ["".join(rng.choice("abc ") for _ in range(rng.randrange(1, 6))) for _ in range(80)]
    nodes = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    got = graph.seeds_by_name(nodes, spark.createDataFrame([(w,) for w in words], "word string"), 4).collect()
    want = {(w, i, names[i]) for w in set(words) - {None} for i in [i for i, n in enumerate(names) if n is not None and w in n.lower()][:4]}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_partitions_do_not_matter(spark, sf):
    docs = tables.table(spark, sf, "documents").selectExpr("lang AS collection", "doc_id AS id", "text")
    ask = tables.table(spark, sf, "benchmark").limit(3).selectExpr("item_id AS query_id", "text")
    got = [sorted(map(str, sparse.search(docs.repartition(n), ask, 3).select("query_id", "collection", "id", "rank").collect())) for n in (1, 7)]
    assert got[0] == got[1]


def test_streams_equal_batches(spark, sf, tmp_path):
    events = tables.table(spark, sf, "events")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ev.read_events(spark, str(tmp_path / "in"), events.schema)
    ev.stream_upsert(stream, "user_id", ["ts", "event_id"], str(tmp_path / "up"), str(tmp_path / "c1")).awaitTermination(120)
    by = ("user_id", ["ts", "event_id"])
    want = sorted(map(tuple, events.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id")).collect()))
    up, less = str(tmp_path / "up"), str(tmp_path / "less")
    read = lambda folder: sorted(map(tuple, ev.latest(spark, folder, *by).select("user_id", "event_id").collect()))
    assert read(up) == want
    assert 0 < spark.read.parquet(f"{up}/v=2").count() <= events.count() // 3 + 1  # a batch writes its own rows alone
    ev.compact(spark, up, less, *by)
    spark.read.parquet(f"{up}/v=1").write.parquet(f"{less}/v=1")  # a batch that comes again
    assert read(less) == want
    one = ev.read_events(spark, str(tmp_path / "in"), events.schema, per_trigger=9)
    ev.stream_tumbling(one, "1 day", "1 hour", str(tmp_path / "win"), str(tmp_path / "c2")).awaitTermination(120)
    closed = spark.read.parquet(str(tmp_path / "win")).select("start", "event_type", "n")
    all_ = ev.tumbling(events, "1 day").select("start", "event_type", "n")
    assert closed.count() > 0 and closed.exceptAll(all_).count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "my_corpus.jsonl").write_text('{"doc_id": "1", "text": "hello", "year": 2020, "topics": ["a"]}\n\nbroken\n{"doc_id": "2", "text": " "}\n')
    assert [r["doc_id"] for r in tables.corpus_records(spark, str(tmp_path / "my_corpus.jsonl")).collect()] == ["1"]
    (tmp_path / "a_b.txt").write_text("x")
    assert tables.text_files(spark, str(tmp_path / "a_b.txt")).first()["title"] == "A B"
    (tmp_path / "k.env").write_text("# c\nA=1\nB = two\nA=3\n")
    assert {tuple(r) for r in tables.key_values(spark, str(tmp_path / "k.env")).collect()} == {("A", "3"), ("B", "two")}
    assert tables.file_listing(spark, str(tmp_path)).count() == 2


def test_clean(spark):
    """Cuts can be read again until they are cleaned; other folders of the shared one stay."""
    rows = tables.cut(spark.range(10))
    assert rows.count() == 10 == rows.count()
    folder = tables.cuts_folder(spark)
    kept = f"{tables.shared_folder(spark)}/siltstone/other/x"
    spark.range(3).write.parquet(kept)
    tables.clean(spark)
    tables.clean(spark)  # nothing left: nothing to do
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{folder}/*")
    assert spark.read.parquet(kept).count() == 3 and tables.cut(spark.range(2)).count() == 2


def test_repeated_turns(spark, tmp_path):
    """Only a turn with the role and the whole text of the one before goes; the export leaves it out too."""
    rows = [(1, 0, "user", "hello"), (1, 1, "user", "hello"), (1, 2, "user", "help"), (1, 3, "assistant", "help"), (2, 0, "user", "x"), (2, 1, "user", "x"), (3, 0, None, None), (3, 1, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    kept = [tuple(r) for r in corpus_queries.dedupe_consecutive(spark, str(tmp_path)).orderBy("conv_id", "turn").collect()]
    assert kept == [rows[0], rows[2], rows[3], rows[4], rows[6]]
    assert [tuple(r) for r in corpus_queries.export_finetune(spark, str(tmp_path)).collect()] == [(1, 3, hashlib.md5(b"user: hello\nuser: help\nassistant: help").hexdigest())]


def test_whole_tables(spark, sf):
    """The queries over whole tables reach every row."""
    run = lambda name: corpus_queries.QUERIES[name][0](spark, sf)
    lines, pending = tables.table(spark, sf, "lineitem"), tables.table(spark, sf, "orders").where("o_orderstatus = 'O'").count()
    n = lines.select("l_orderkey", "l_linenumber").distinct().count()
    assert run("schema_frequency").agg(F.sum("frequency")).first()[0] == n == run("fact_table").agg(F.sum("mentions")).first()[0]
    assert pending > 500 and run("queue_order").count() == pending
    assert run("passage_from_facts").count() == lines.select("l_orderkey").distinct().count()


def test_contained(spark):
    import random

    rng = random.Random(1)
    text = lambda: " ".join(rng.choice("ab abc b bc c ca".split()) for _ in range(rng.randrange(1, 7)))
    rows = [(rng.randrange(3), i, text()[rng.randrange(2) :] + rng.choice(["", " ", "\t"])) for i in range(300)]
    got = {r["id"] for r in context.drop_contained(spark.createDataFrame(rows, "g int, id int, text string"), ["g"]).collect()}
    assert got == {i for g, i, t in rows if not any(g == h and len(u) > len(t) and t in u for h, _, u in rows)}


def test_contained_moves_few_rows(spark):
    """Long lines are met by narrow keys: what is shuffled stays a small multiple of the texts; before, a text was repeated for each of its words."""
    import random

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    words = [word() for _ in range(3000)]
    long = [" ".join(rng.choice(words) for _ in range(rng.randrange(100, 300))) for _ in range(600)]
    part = [t[a : a + rng.randrange(20, 400)] for t in long[:200] for a in [rng.randrange(len(t) // 2)]]
    near = [long[0].replace(w, w + "x", 1) for w in long[0].split()[3:60]]
    odd = ["", " ", "\t", words[5], words[6][1:], f"{words[7]} ", f" {words[8]}", long[3][100:112], long[4].split()[3] + "\t", "zz", "q r s", f"{long[5].split()[4]} {long[5].split()[5][:1]}"]
    texts = long + part + near + odd
    rows = spark.createDataFrame([(i % 2 if i % 400 else None, i, t) for i, t in enumerate(texts)] + [(0, 9000, None)], "g int, id int, text string").repartition(4)
    store = lambda: sum(s.shuffleWriteBytes() + s.diskBytesSpilled() for s in _stages(spark))
    before = store()
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for large tables
    try:
        got = {r["id"] for r in context.drop_contained(rows, ["g"]).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    moved = store() - before
    data = [tuple(r) for r in rows.collect()]
    assert got == {i for g, i, t in data if t is None or g is None or not any(g == h and u is not None and len(u) > len(t) and t in u for h, _, u in data)}
    assert moved < 12 * sum(len(t) for t in texts)  # 8 times; 17 with a copy for each word


def _stages(spark):
    gateway = spark.sparkContext._gateway
    found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return [found.apply(i) for i in range(found.size())]
