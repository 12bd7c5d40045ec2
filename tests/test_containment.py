"""Contained texts against plain loops, and how little of the texts is moved."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import containment, context


def _words(rng, many=3000):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(many)]


def _alone(data):
    """Ids of (group, id, text) that no longer text of their group holds."""
    return {i for g, i, t in data if not any(g == h and len(u) > len(t) and t in u for h, _, u in data)}


def _moved(spark):
    gateway = spark.sparkContext._gateway
    found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(found.apply(i).shuffleWriteBytes() + found.apply(i).diskBytesSpilled() for i in range(found.size()))


def test_disk_stays_below_texts(spark):
    """What is shuffled is less than the texts; before, ten times as much as they are, since all keys of windows, and texts themselves, were."""
    rng = random.Random(4)
    words = _words(rng)
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(20, 90))) for _ in range(3000)]
    texts += [t[a : a + rng.randrange(20, 200)] for t in texts[:100] for a in [rng.randrange(len(t) // 2)]] + ["zz zzz", words[3], f"{texts[5].split()[4]} {texts[5].split()[5][:1]}"] + texts[:50]
    data = [("s", i, t) for i, t in enumerate(texts)]
    rows = spark.createDataFrame(data, "g string, id int, text string").repartition(8).localCheckpoint()
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for large tables
    try:
        before = _moved(spark)
        got = [r["id"] for r in context.dedupe_contained(rows, ["g"]).select("id").collect()]
        moved = _moved(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert len(got) == len(set(got)) and set(got) == _alone(data[: len(texts) - 50])
    assert moved < sum(map(len, texts))


@pytest.mark.parametrize("most", [containment.MOST_SHORT, 700])
def test_short_texts(spark, monkeypatch, most):
    """Texts of one or two tokens of any length, in letters of one to four bytes, sent to all at once or in parts, and white space that tells equal words apart."""
    monkeypatch.setattr(containment, "MOST_SHORT", most)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abé€𝄞") for _ in range(rng.choice([1, 2, 3, 5, 9, 20, 45])))
    long = [rng.choice([" ", "\t"]).join(word() for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    cut = [t[a : a + rng.randrange(1, 100)] for t in long for a in [rng.randrange(len(t))]]
    odd = ["", " ", "\t", "a", "é", "€", " a", "a ", "b\ta", "b a", "é" * 70, "x" + "é" * 70, long[0] + "x", long[1] + "\n" + long[1]]
    data = [(i % 2, i, t) for i, t in enumerate([*long, *cut, *odd, *odd])]
    got = {r["id"] for r in context.drop_contained(spark.createDataFrame(data, "g int, id int, text string").repartition(5), ["g"]).collect()}
    assert got == _alone(data)


def test_copies_hold_nothing(spark):
    """Of texts that are equal up to white space only the first, which is the longest, holds others."""
    texts = ["p a b q r s t u", "p  a  b  q r s t u", "a b", "a  b", "b q r s", "b q  r s", "x y z", "x y z", "w x y z", None]
    rows = spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "g string, id int, text string")
    want = context.drop_contained(context.dedupe(rows, ["g"]), ["g"])
    assert sorted(map(tuple, context.dedupe_contained(rows, ["g"]).collect())) == sorted(map(tuple, want.collect()))


def test_large_bitmaps(spark, monkeypatch):
    """Bitmaps of several blocks, and such as are full, lose no key."""
    rng = random.Random(6)
    words = _words(rng, 200)
    long = [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 60))) for _ in range(200)]
    data = [(0, i, t) for i, t in enumerate(long + [t[3 : rng.randrange(12, 90)] for t in long])]
    rows = spark.createDataFrame(data, "g int, id int, text string").repartition(4).localCheckpoint()
    for spare, most in ((1 << 15, 27), (32, 5)):
        monkeypatch.setattr(containment, "SPARE", spare)
        monkeypatch.setattr(containment, "MOST_BITMAP", most)
        assert {r["id"] for r in context.drop_contained(rows, ["g"]).collect()} == _alone(data)


def test_marks(spark):
    rows = spark.range(-3, 200).withColumnRenamed("id", "_row")
    some = containment.marks(rows.where("_row % 7 = 0"))
    for yes in (True, False):
        assert {r["_row"] for r in containment.marked(rows, some, yes).collect()} == {i for i in range(-3, 200) if (i % 7 == 0) == yes}
    assert containment.marked(rows.where(F.lit(False)), some).count() == 0
