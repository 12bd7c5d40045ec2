"""Registered queries against their DuckDB forms, over the test tables and over documents with planted cases."""

import os
import random

import duckdb
import pytest

from siltstone.llm import queries

ORACLES = queries.oracle_sql()
OF_DOCUMENTS = ["op1_suffix_dedup", "op2_minhash", "op10_mixing"]


def compare(spark, folder, name):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{folder}/{f}{'/*.parquet' if os.path.isdir(f'{folder}/{f}') else ''}')")
    got = con.execute(ORACLES[name])
    names = [d[0] for d in got.description]
    df = queries.queries()[name](spark, folder)
    assert sorted(names) == sorted(df.columns)
    rows = [tuple(r) for r in df.select(*names).collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, got.fetchall()))
    return rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf, name):
    assert compare(spark, sf, name)


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Null, empty and short texts, exact and near copies, chains of near copies, runs that touch, texts of one repeated letter, letters
    of several bytes, one source with most rows, a null source."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7)))
    base = [word() for _ in range(120)]
    passage = " ".join(base[:40])
    texts = [None, "", " \t\n", "one two three", "One TWO three", "x" * 99, "x" * 100, "x" * 101, "x" * 350, "é" * 60, "a" + "é" * 70, " ".join(base), " ".join(base).upper()]
    for i in range(12):
        chain = list(base)
        chain[5 * i : 5 * i + 2] = [f"new{i}", f"more{i}"]
        base = chain if i % 2 else base
        texts.append(" ".join(chain))
    texts += [f"{word()} {passage} {word()} {passage}", passage + passage, " ".join(word() for _ in range(200)), f"İ {passage[:150]} ſ {passage[100:260]}"]
    texts += [" ".join(word() for _ in range(rnd.randint(0, 30))) for _ in range(600)]
    rows = [(i, t, "en", None if i % 97 == 0 else "hot" if i % 3 else f"s{i % 7}", len(t or "")) for i, t in enumerate(texts)]
    folder = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/none/documents.parquet")
    os.rename(f"{folder}/none", f"{folder}-none")
    return folder


@pytest.mark.parametrize("name", OF_DOCUMENTS)
def test_planted(spark, planted, name):
    rows = compare(spark, planted, name)
    assert len(rows) == spark.read.parquet(f"{planted}/documents.parquet").count()


@pytest.mark.parametrize("name", OF_DOCUMENTS)
def test_empty_table(spark, planted, name):
    assert queries.queries()[name](spark, f"{planted}-none").collect() == []
