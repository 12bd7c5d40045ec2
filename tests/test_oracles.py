"""Every registered query of the reference's operators against its DuckDB form."""

import os

import duckdb
import pytest

from siltstone.plans import registry

ORACLES = registry.oracle_sql()


def shown(rows):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    if name not in ORACLES:
        assert rows
        return
    got = duck.execute(ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert shown(rows) == shown([tuple(r[i] for i in at) for r in got.fetchall()])


def test_what_has_no_oracle_is_known():
    """These are held against plain Python in test_chunking and test_semantics, and against exact search in test_indexes."""
    assert set(registry.queries()) - set(ORACLES) == {"sanitize_pages", "sanitize_compare", "chunk_dispatch", "ingest_chunks", "dense_cells"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
