"""The flagship against its SQL on states whose prices hang on a last bit, and the closed binomial."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tallyspark.functions import pmf as P

#: (session lengths by week, successes among the last events before the latest): chances of exactly a half, of an exact half in the
#: sixth place (rates 0.3 and 0.85), and within 1e-7 of one.
STATES = [
    ([9, 9, 9, 9], 15), ([11, 11, 11, 11], 15), ([13, 13, 13, 13], 15), ([7, 7, 7, 7, 7], 9), ([5, 5, 5, 6], 17),
    *(([n, n], k) for n, k in ((36, 16), (35, 17), (34, 18), (33, 19), (32, 20), (31, 21), (30, 20), (29, 22), (25, 23), (24, 24), (22, 25), (20, 26))),
]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    d = str(tmp_path_factory.mktemp("states"))
    events, lines = [], []
    for user, (sessions, k) in enumerate(STATES):
        seen = sum(sessions) - 1
        hits = [False] * (seen - min(30, seen)) + [i < k for i in range(min(30, seen))] + [False]
        times = [dt.datetime(2024, 1, 1 + 7 * week, 0, i) for week, n in enumerate(sessions) for i in range(n)]
        events += [(1000 * user + i, ts, user, "purchase" if hit else "view", 1.0, '{"k": 3}') for i, (ts, hit) in enumerate(zip(times, hits, strict=True))]
        for line in range(4):
            lines += [(10 * len(lines) + 10 * v + 1, user, v, 1, 4.0 + line, 100.0, (v + 2 + 3 * line) % 11 / 100, (v + line) % 9 / 100) for v in range(8)]
    c = duckdb.connect()
    c.execute("CREATE TABLE e (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    c.execute("CREATE TABLE l (l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INTEGER, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE)")
    c.executemany("INSERT INTO e VALUES (?, ?, ?, ?, ?, ?)", events)
    c.executemany("INSERT INTO l VALUES (?, ?, ?, ?, ?, ?, ?, ?)", lines)
    c.execute(f"COPY e TO '{d}/events.parquet'")
    c.execute(f"COPY (SELECT *, TIMESTAMP '2000-01-01' AS l_shipdate FROM l) TO '{d}/lineitem.parquet'")
    c.execute(f"COPY (SELECT DISTINCT l_orderkey AS o_orderkey, TIMESTAMP '2000-01-02' AS o_orderdate FROM l) TO '{d}/orders.parquet'")
    return d


def test_flagship_equals_its_sql_to_the_last_bit(spark, tables):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in ("events", "lineitem", "orders"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    ours = E.queries()["board_flagship"](spark, tables)
    want = sorted(tuple(map(repr, r)) for r in c.execute(f"SELECT {', '.join(ours.columns)} FROM ({E.oracle_sql()['board_flagship']})").fetchall())
    got = sorted(tuple(map(repr, r)) for r in ours.collect())
    assert len(want) == 32 * len(STATES) and got == want


def test_binomial(spark):
    rows = spark.createDataFrame([(0.3, 7), (0.95, 36), (1e-4, 1), (0.5, 40), (0.2, 0)], "p double, n int")
    for r in rows.select("*", P.binomial("p", "n").alias("a"), P.poisson_binomial(F.array_repeat("p", F.col("n"))).alias("b")).collect():
        assert len(r.a) == r.n + 1 and list(r.a) == pytest.approx(list(r.b), rel=1e-9)
