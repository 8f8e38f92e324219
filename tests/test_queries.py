"""Every registered query with SQL against DuckDB, and the others for a stable, non-empty result."""

import glob
import math

import duckdb
import pytest

import __spark_entry__ as E

DIR = "/root/testdata/sf0.001"
TABLES = [p.rsplit("/", 1)[-1][:-8] for p in glob.glob(f"{DIR}/*.parquet")]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def text(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v)


OWN = sorted(n for n in E.queries() if not n.startswith("op") and n != "pipeline")


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    df = E.queries()[name](spark, DIR)
    rows = df.collect()
    if name not in E.oracle_sql():
        assert rows
        return
    got = duck.execute(E.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    ours = sorted(tuple(text(r[c]) for c in order) for r in rows)
    theirs = sorted(tuple(text(r[columns.index(c)]) for c in order) for r in got.fetchall())
    assert ours == theirs


def test_entry(spark):
    assert E.entry(spark).count() >= 0


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
