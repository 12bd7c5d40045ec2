"""Near-duplicates of texts and vectors, and exact search, against brute force."""

import collections
import itertools
import math
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import common, cross_polytope, minhash, mixing, vafile
from siltstone.llm.common import Scratch, table
from siltstone.llm.components import components


def shingles(text):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_texts(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    seen = collections.defaultdict(list)
    for i in sorted(sets):
        common = collections.Counter(j for g in sets[i] for j in seen[g])
        for g in sets[i]:
            seen[g].append(i)
        for j, c in common.items():
            if 100 * c >= 75 * (len(sets[i]) + len(sets[j]) - c):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_texts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(400)]
    base = list(rng.choice(words, 120))
    rows = []
    for i in range(60):  # a chain of near copies, and a group around one text
        copy = list(base)
        for at in rng.choice(120, 3 + i % 4, replace=False):
            copy[at] = f"n{i}_{at}"
        rows.append((5000 + i, " ".join(copy)))
    rows += [(6000, None), (6001, ""), (6002, " \t\n"), (6003, "One two"), (6004, "one  TWO"), (6005, "one two three"), (6006, "É a b c d"), (6007, "é a b c d"), (6008, "a " * 9000)]
    extra = spark.createDataFrame(rows, "doc_id long, text string")
    all_ = docs.unionByName(extra).withColumns({"n": F.lit(1), "cell": F.lit("x"), "x": F.lit(0)})
    got = {r["doc_id"]: r for r in minhash.near_duplicates(all_).collect()}
    want = brute_texts([tuple(r) for r in docs.collect()] + rows)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())
    odd = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in minhash.near_duplicates(odd).collect()) == [("1", "1", True), ("1", "1", True), ("2", "1", False), ("None", "None", True)]
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


def test_cell_with_an_outsider(spark):
    """A cell of 50,000 documents of one part and a single other: work in proportion to the cell, and the one possible pair is found."""
    bits = F.array(*[F.lit(0).cast("long")] * minhash.SKETCH)
    far = F.array(*[F.lit(-1).cast("long")] * minhash.SKETCH)
    cell = spark.range(50_000).select(F.lit(1).cast("long").alias("cell"), F.col("id").alias("doc"), F.lit(0).cast("long").alias("part"), F.lit(20).cast("long").alias("n"), F.when(F.col("id") == 777, bits).otherwise(far).alias("bits"))
    other = spark.range(1).select(F.lit(1).cast("long").alias("cell"), F.lit(60_000).cast("long").alias("doc"), F.lit(60_000).cast("long").alias("part"), F.lit(20).cast("long").alias("n"), bits.alias("bits"))
    assert [tuple(r) for r in minhash.across(cell.union(other)).collect()] == [(60_000, 777)]


def test_pairs_across_parts(spark, monkeypatch):
    monkeypatch.setattr(minhash, "COMPARED", 50)
    rng = np.random.default_rng(9)
    rows = [(int(c), int(d), int(p)) for d in range(120) for c, p in [(rng.integers(0, 4), rng.choice([0, 0, 0, 1, 2, 3 + d]))]]
    bits = F.array(*[F.lit(5).cast("long")] * minhash.SKETCH)
    members = spark.createDataFrame(rows, "cell long, doc long, part long").withColumns({"n": F.lit(9).cast("long"), "bits": bits})
    want = {(x, y) for a, x, p in rows for b, y, q in rows if a == b and p != q and x > y}
    assert {tuple(r) for r in minhash.across(members).collect()} == want


def test_confirm_with_a_hub(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PARTNERS", 3)
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(i, base + f" t{i}" if i % 3 else f"o{i} " * 60 + str(i)) for i in range(40)]
    pairs = [(i, 0) for i in range(1, 30)] + [(39, i) for i in range(1, 39)] + [(1, 31)]
    sets = {i: shingles(t) for i, t in rows}
    want = {(x, y) for x, y in pairs if 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y])}
    got = minhash.confirm(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(pairs, "x long, y long"))
    assert {tuple(r) for r in got.collect()} == want


def test_chance_of_a_miss():
    s = 0.75**minhash.ROWS
    assert 1 - (1 - (1 - s) ** minhash.SIDE) ** 2 < 2e-4


def test_clean(spark, tmp_path):
    work = common.Scratch(spark, "test")
    rows = work.table(spark.range(10).withColumn("part", F.col("id") % 2), "rows", "part")
    work.drop_part(rows, "part=1")
    assert spark.read.parquet(rows.scratch_path).count() == 5
    common.clean(spark)
    common.clean(spark)  # nothing left: nothing to do
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(rows.scratch_path)
    assert common.Scratch(spark, "test").table(spark.range(3), "rows").count() == 3


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(i, i + 1) for i in range(300, 340)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(pairs, "u long, v long"), Scratch(spark, "t")).collect()}
    root = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in range(200):
        for a, b in pairs:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


def cosine(a, b):
    return math.fsum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(math.fsum(x * x for x in a) * math.fsum(y * y for y in b))


def test_vectors(spark, sf):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 24))
    rows = [(i, (base[i % 6] + rng.normal(size=24) * rng.choice([0.0, 0.1, 0.22])).tolist()) for i in range(150)]
    rows += [(500, rows[0][1]), (501, rows[0][1]), (502, [2 * x for x in rows[0][1]])]
    good = list(rows)
    rows += [(600, None), (601, []), (602, [0.0] * 24), (603, [float("nan")] * 24), (604, [None] * 24), (605, [float("inf")] + [1.0] * 23), (606, [1.0]), (None, rows[0][1])]
    links = [(a, b) for (a, x), (b, y) in itertools.combinations(good, 2) if cosine(x, y) >= 0.95]
    degree = collections.Counter(i for p in links for i in p)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("copies", F.lit(0))
    got = {r["vec_id"]: r for r in cross_polytope.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    assert sum(r["n_links"] for r in got.values()) >= 0.99 * 2 * len(links)
    assert all(r["n_links"] <= degree[i] for i, r in got.items() if i is not None)
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in (600, 601, 602, 603, 604, 605, 606))
    assert got[501]["component_id"] == got[0]["component_id"] == got[502]["component_id"]
    assert cross_polytope.near_duplicates(df.limit(0)).count() == 0


def test_vectors_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    one = rng.normal(size=32)
    rows = [(i, (one + rng.normal(size=32) * 0.02).tolist()) for i in range(90)]
    monkeypatch.setattr(cross_polytope, "BLOCK", 16)
    got = cross_polytope.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(89, 0)}


def test_recall(spark, sf):
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in table(spark, sf.replace("sf0.001", "sf0.01"), "embeddings").collect()]
    x = np.stack([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (np.triu(x @ x.T, 1) >= 0.95).sum()
    c = cross_polytope.codes(x)
    a, b = np.nonzero(np.triu(x @ x.T, 1) >= 0.95)
    met = ((c[a][:, :, :1] == c[b]) | (c[b][:, :, :1] == c[a])).any(axis=(1, 2))
    assert met.sum() >= 0.99 * want


def test_search(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=8) / 3).tolist()) for i in range(400)] + [(400 + i, [0.5] * 8) for i in range(40)]
    good = list(rows)
    rows += [(900, None), (950, [float("nan")] * 8), (1000, [None] * 8), (None, [1.0] * 8), (1050, [0.25] * 5)]
    good.append((1050, [0.25] * 5 + [0.0] * 3))
    ints = {i: [math.floor(256 * x) for x in v] for i, v in good}
    want = []
    for q in ints:
        if q % 50 == 0:
            best = sorted(((-sum(a * b for a, b in zip(ints[q], ints[v], strict=True)), v) for v in ints if v != q))[:5]
            want += [(q, r, v, -s) for r, (s, v) in enumerate(best, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in vafile.search(df, F.col("vec_id") % 50 == 0, 5).collect()]
    assert sorted(got) == sorted(want)
    few = vafile.search(df.where("vec_id < 3"), F.col("vec_id") == 0, 5)
    assert few.count() == 2
    assert vafile.search(df.limit(0), F.col("vec_id") == 0, 5).count() == 0


def test_search_of_many(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=8) / 3).tolist()) for i in range(300)]
    ints = np.array([[math.floor(256 * x) for x in v] for _, v in rows])
    for k in (15, 16, 20):
        want = [(q, r, v, int(ints[q] @ ints[v])) for q in range(0, 300, 50) for r, v in enumerate(sorted((v for v in range(300) if v != q), key=lambda v: (-(ints[q] @ ints[v]), v))[:k], 1)]
        got = vafile.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, k)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_search_of_huge_values(spark):
    """Finite components of any size take part; scores are exact, in order, and held within a long."""
    rng = np.random.default_rng(10)
    big = [1e30, -1e30, 1.7e308, -1.7e308, 3e15, -3e15, 2.0**55, 5e-324, 0.0, -0.0]
    rows = [(i, [float(x) for x in rng.choice(big, 6)]) for i in range(80)] + [(100 + i, (rng.normal(size=6) * 10.0 ** rng.integers(-2, 18)).tolist()) for i in range(80)]
    rows += [(300, rows[3][1]), (300, rows[3][1]), (301, rows[3][1])]
    ints = {i: [math.floor(Fraction(x) * 256) for x in v] for i, v in rows}
    want = []
    for q in sorted(ints):
        if q % 10 == 0:
            best = sorted((-sum(a * b for a, b in zip(ints[q], ints[v], strict=True)), v) for v in ints if v != q)[:5]
            want += [(q, r, v, min(max(-s, -(2**63)), 2**63 - 1)) for r, (s, v) in enumerate(best, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"q": F.lit(1), "v": F.lit("x"), "class": F.lit(2), "key": F.lit(3)})
    got = vafile.search(df, F.col("vec_id") % 10 == 0, 5)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_cell_edges():
    rng = np.random.default_rng(11)
    for scale in (1, 0.01, 1e5, 1e9, 1e200, 1.7e308):
        v = rng.uniform(-1, 1, (4000, 3)) * scale
        v = np.where(np.abs(v) < 2**44, np.floor(np.clip(v, -(2.0**44), 2.0**44) * 256) / 256, v)
        low, high = np.minimum(v.min(0), 0), np.maximum(v.max(0), 0)
        step, least, most = vafile.cell_edges(low, high)
        code = np.clip(np.floor(v / step - low / step), 0, 63).astype(int)
        d = np.arange(3)
        assert (least[code, d] <= v).all() and (v <= most[code, d]).all() and (scale < 1 or code.max() >= 60)


def test_pfair():
    rng = np.random.default_rng(7)
    for _ in range(60):
        weights = {f"s{i}": float(rng.choice([1, 2, 3, 0.5, 7, 0.01])) for i in range(rng.integers(1, 12))}
        share = mixing.shares(weights, int(rng.choice([10, 50, 1000])))
        cycle, had = sum(share.values()), dict.fromkeys(share, 0)
        for t, (s, i, release, due) in enumerate(mixing.schedule(share)):
            assert i == had[s] and release <= t < due
            had[s] += 1
            assert all(abs(had[x] * cycle - share[x] * (t + 1)) < cycle for x in share)
        assert had == share


def test_mixing(spark):
    rows = [(i, s) for s, n in (("a", 500), ("b", 90), ("c", 7), (None, 33)) for i in range(n)] + [(None, "a"), (3, "a"), (3, "a")]
    df = spark.createDataFrame(rows, "doc_id long, source string").withColumns({"mix_slot": F.lit("old"), "keep": F.lit(1)})
    out = mixing.mix(df, {"a": 3, "b": 2, "c": 1}, block=4)
    got = out.orderBy("mix_place").collect()
    assert out.columns[:3] == ["doc_id", "source", "keep"] and len(got) == len(rows) == len({r["mix_place"] for r in got})
    assert sorted(map(str, [(r["doc_id"], r["source"]) for r in got])) == sorted(map(str, rows))
    slots = sorted({(r["mix_slot"], r["source"], r["mix_block"], r["mix_release"], r["mix_deadline"], r["mix_phase"]) for r in got}, key=lambda x: x[0])
    assert [s[0] for s in slots] == list(range(len(slots))) and all(s[3] <= s[0] < s[4] for s in slots)
    had = collections.Counter()
    for t, s in enumerate(x for x in slots if x[5] == 0):
        had[s[1]] += 1
        assert all(abs(had[k] - w / 6 * (t + 1)) < 1.01 for k, w in (("a", 3), ("b", 2), ("c", 1)))
    for s in ("a", "b", "c", None):
        assert [r["mix_block"] for r in got if r["source"] == s] == sorted(r["mix_block"] for r in got if r["source"] == s)
    assert mixing.mix(df.limit(0)).count() == 0


def test_exact_targets():
    """Every source stays within a block of its unrounded share, over many cycles and in every phase."""
    cases = [({f"s{i}": 1 for i in range(3)}, 30_000), ({f"s{i}": 1 for i in range(19)}, 5_000), ({"a": 0.7, "b": 0.2999, "c": 0.0001}, 40_000), ({"a": 1 / 3, "b": 2 / 7, "c": 1e-9}, 3_000), ({"a": 1, "b": 1e-300}, 50)]
    for weights, n in cases:
        counts = {s: n + 7 * k for k, s in enumerate(weights)}
        total = sum(Fraction(str(w)) for w in weights.values())
        target = {s: Fraction(str(w)) / total for s, w in weights.items()}
        had, seen = collections.Counter(), {}
        for t, row in enumerate(mixing.placed(counts, weights)):
            s, i, phase, slot, release, due = row
            assert slot == t and i == had[s] and release <= t < due
            had[s] += 1
            seen[s, i] = (phase, slot, release, due)
            if not phase and t % 97 < 3:
                assert all(abs(had[x] - target[x] * (t + 1)) < 1 for x in weights), (weights, t)
        assert had == counts
        phases = mixing.plan(counts, weights, 10**6)
        for p, ph in enumerate(phases):
            for s, m in ph["taken"].items():
                mine = [(k, *o) for k, o in enumerate(ph["order"]) if o[0] == s]
                for b in range(m):
                    k, _, i, release, due = mine[b % ph["share"][s]]
                    base = ph["slot"] + b // ph["share"][s] * ph["cycle"]
                    assert seen[s, ph["first"][s] + b] == (p, base + k, base + release, base + min(due, mixing.FAR))


def test_mixing_by_table(spark, monkeypatch):
    rows = [(i, s) for s, n in (("a", 200), ("b", 90), ("c", 7), (None, 33)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    for weights in (None, {"a": 3, "b": 0.1, None: 1e-300}):
        one = sorted(map(str, mixing.mix(df, weights, block=4).collect()))
        with monkeypatch.context() as m:
            m.setattr(mixing, "MOST_SOURCES", 3)
            m.setattr(mixing, "PLAN_ROWS", 40)
            assert sorted(map(str, mixing.mix(df, weights, block=4).collect())) == one
    assert len(one) == len(rows)


def test_mixing_of_many_sources(spark):
    """1,001 sources over 100,000 blocks: less than a block off the exact targets at any time."""
    weights = {f"s{i}": 1 + i % 7 for i in range(1001)}
    total = sum(weights.values())
    had, t = collections.Counter(), 0
    for s, *_ in mixing.placed({s: 10**6 for s in weights}, weights):
        had[s] += 1
        t += 1
        assert abs(had[s] - Fraction(weights[s] * t, total)) < 1
        if t % 10_007 == 0:
            assert all(abs(had[x] - Fraction(w * t, total)) < 1 for x, w in weights.items())
        if t == 100_000:
            break


def test_mixing_keeps_columns_and_odd_weights(spark):
    rows = [(i, s) for s in "abcd" for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, source string").withColumns({"_extra": F.lit(1), "n": F.lit("x"), "row": F.lit(2), "_id": F.lit(3), "tie": F.lit(4), "part": F.lit(5)})
    got = mixing.mix(df, {"a": None, "b": 0, "c": -2, "d": 5}, block=5)
    assert got.columns[:8] == df.columns and {(r["_extra"], r["n"], r["row"], r["_id"], r["tie"], r["part"]) for r in got.collect()} == {(1, "x", 2, 3, 4, 5)}
    order = [r["source"] for r in got.orderBy("mix_place").collect()]
    assert order[:20] == ["d"] * 20 and len(order) == 80


def test_registered_mixing(spark, sf):
    """op10 against a plain earliest-deadline-first loop over exact fractions."""
    from siltstone.llm import queries

    docs = collections.defaultdict(list)
    for r in table(spark, sf, "documents").collect():
        docs[r["source"]].append(r["doc_id"])
    left, done, want, slot = {s: -(-len(x) // mixing.BLOCK) for s, x in docs.items()}, collections.Counter(), {}, 0
    while left:
        w, start, had = Fraction(1, len(left)), slot, collections.Counter()
        while all(left.values()):
            t = slot - start
            ready = [s for s in left if math.floor(had[s] / w) <= t]
            s = min(ready, key=lambda s: (math.ceil((had[s] + 1) / w), (had[s] + 1) / w % 1 == 0, s))
            for k, doc in enumerate(sorted(docs[s])[mixing.BLOCK * done[s] : mixing.BLOCK * (done[s] + 1)]):
                want[doc] = slot * mixing.BLOCK + k
            had[s], done[s], left[s], slot = had[s] + 1, done[s] + 1, left[s] - 1, slot + 1
        left = {s: n for s, n in left.items() if n}
    assert {r["doc_id"]: r["mix_place"] for r in queries.op10_mixing(spark, sf).collect()} == want
