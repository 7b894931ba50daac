"""Every registered query of the engine against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from tessera import catalogue

TINY = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{TINY}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, TINY)
    if name not in catalogue.SQL:
        got.collect()
        return
    want = con.sql(catalogue.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted((repr([plain(r[c]) for c in want.columns]) for r in got.collect()))
    assert rows == sorted(repr([plain(v) for v in r]) for r in want.fetchall())


def test_entry_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
