"""Mixing, URL filters and their SQL on small tables with every odd row."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyspark.llm.mixing import OP8_SQL, emitted, mixed, op8_source_mixing, targets
from tallyspark.llm.urls import LISTED_SITES, OP5_SQL, RULES, canonical, judge, op5_url_filter


def both(spark, tmp_path, name, df, query, sql):
    df.write.parquet(str(tmp_path / f"{name}.parquet"))
    ours = query(spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = c.execute(sql)
    columns = [x[0] for x in got.description]
    assert sorted(columns) == sorted(ours.columns)
    order = sorted(columns)
    a = sorted(str([r[k] for k in order]) for r in ours.collect())
    b = sorted(str([r[columns.index(k)] for k in order]) for r in got.fetchall())
    assert a == b
    return ours


DOCS = [(i, "w " * (i % 50), f"s{i % 7}", "x") for i in range(300)] + [(1000, None, "s1", "x"), (1001, "", None, "x"), (1002, "a\u00a0b c\u000bd", None, "x"), (None, "q w e", "é", "x"), (1003, "z " * 30_000, "big", "x"), (1004, "only", "\U0001f600", "x"), (5, "w " * 5, "s5", "x")]
SCHEMA = "doc_id long, text string, source string, target string"


def test_mixing_equals_sql(spark, tmp_path):
    both(spark, tmp_path, "documents", spark.createDataFrame(DOCS, SCHEMA), op8_source_mixing, OP8_SQL)


def test_targets_by_repeated_sharing(spark):
    """The one-pass level equals resharing the excess until no target is above its cap."""
    sizes = {"a": 10, "b": 1000, "c": 3, "d": 500, "e": 0, None: 77}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.mix_source: r.target for r in targets(df).collect()}
    names = [*sorted(x for x in sizes if x), None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, open_, want = sum(sizes.values()), set(names), {}
    while True:
        left = total - sum(want.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not full:
            want |= share
            break
        want |= {s: 3 * sizes[s] for s in full}
        open_ -= set(full)
    assert got == {s: pytest.approx(want[s], abs=1e-5) for s in names}
    assert sum(got.values()) == pytest.approx(total)


def test_targets_do_not_depend_on_the_ranges(spark):
    rows = [(None if i == 40 else f"s{i * 7919 % 101}", (i * 37) % 90 * (50 if i % 5 == 0 else 1)) for i in range(200)]
    df = spark.createDataFrame(rows, "source string, size long")
    whole = sorted(map(str, targets(df).collect()))
    assert len(whole) == 102
    for a_range in (1, 7, 60):
        assert sorted(map(str, targets(df, a_range).collect())) == whole
    assert targets(df.limit(0)).collect() == []


def test_mix_comes_near_its_targets_and_is_emitted(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i % 9), f"s{i % 4}", "x") for i in range(6000)], SCHEMA)
    taken = {r.source: (r.taken, r.most) for r in mixed(df.drop("target")).groupBy("source").agg(F.sum(F.col("mix_size") * F.col("mix_copies")).alias("taken"), F.max("mix_copies").alias("most")).collect()}
    goal = {r.mix_source: r.target for r in targets(df.select("source", F.size(F.split(F.trim("text"), " ")).cast("long").alias("size"))).collect()}
    assert all(abs(taken[s][0] - goal[s]) < 0.06 * goal[s] and taken[s][1] <= 3 for s in goal)
    out = emitted(df.drop("target"))
    assert out.columns == ["doc_id", "text", "source"]
    assert out.count() == mixed(df.drop("target")).agg(F.sum("mix_copies")).first()[0]


def test_empty_mix(spark):
    assert mixed(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/es/1", "https://example.org/es/", "https://a.b.example.org/en/12?x=1", "https://example.org/en/2", "http://notexample.org/es/3", "ftp://x.com/de/", "http://x.com/fr/9#t", "http://com/de/1", "http://x.com", "http://x.com?q=/de/", "http://x.net#a/b", "http://ÄB.com/de/x", "http://org/", "http://www.spam-farm.example.com/en/1?utm_source=feed", "http://spam-farm.example.com/en/1/", "https://spam-farm.example.com/en/1?page=2&ref=x", "http://m.free-bets.example.org/en/4", "http://a.com/x\ny", "http://a://b/c", "http://user@h.com:80/de/"]


def test_urls_equal_sql(spark, tmp_path):
    rows = [(i, u, "<p>", "v") for i, u in enumerate(URLS + URLS)]
    out = both(spark, tmp_path, "pages", spark.createDataFrame(rows, "page_id long, url string, html string, verdict string"), op5_url_filter, OP5_SQL)
    got = {r.page_id: r for r in out.collect()}
    assert [(got[i].rule, got[i].verdict) for i in (4, 6, 7, 8, 9, 10, 11, 12)] == [
        ("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), ("org/", "allow"), ("com/de/", "block"), ("com/fr/", "allow"), ("com/de/", "block"), (None, "allow")]
    assert [got[i].verdict for i in (17, 18)] == ["block", "block"]


def test_bloom_false_positives_are_removed(spark, monkeypatch):
    import tallyspark.llm.urls as U

    monkeypatch.setattr(U, "MOST_BLOCKS", 1)
    pages = spark.createDataFrame([(i, f"http://h{i}.net/p") for i in range(400)], "page_id long, url string")
    listed = pages.where("page_id % 2 = 0").select(canonical(F.col("url")).alias("canonical"))
    got = {r.page_id: r.listed for r in judge(pages, listed, RULES).collect()}
    assert got == {i: i % 2 == 0 for i in range(400)}
    # The filter alone lets unlisted pages through here, and never fails a listed one.
    parsed = pages.select("page_id", canonical(F.col("url")).alias("canonical_url"))
    possible = {r.page_id: r.possible for r in U.probed(parsed, listed).collect()}
    assert all(possible[i] for i in range(0, 400, 2)) and any(possible[i] for i in range(1, 400, 2))
    none = judge(pages, listed.limit(0), ())
    assert {r.verdict for r in none.collect()} == {"allow"} and judge(pages.limit(0), listed).count() == 0
    assert len(LISTED_SITES) == 6


def test_pages_of_one_host_differ(spark):
    """The list names pages, not hosts, and only their canonical form: variants of a listed page are listed too."""
    rows = [(i, f"http://{'www.' if i % 2 else ''}site.net/p{i // 2}{'/' if i % 2 else '?ref=x'}") for i in range(800)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    from tallyspark.llm.urls import listed_urls

    got = {r.page_id: r.verdict for r in judge(pages, listed_urls(pages)).collect()}
    assert all(got[i] == got[i + 1] for i in range(0, 800, 2))
    assert 10 < sum(v == "block" for v in got.values()) < 120


def test_size_of_the_filter():
    from tallyspark.llm.urls import MOST_BLOCKS, URLS_PER_BLOCK, number_of_blocks

    assert [number_of_blocks(n) for n in (0, 1, 8, 9, 17, 10**12)] == [1, 1, 1, 2, 4, MOST_BLOCKS]
    assert all(number_of_blocks(n) * URLS_PER_BLOCK >= n for n in (100, 12_345, 10**6))


def test_mixing_keeps_columns_with_its_own_names(spark):
    rows = [(i, "w " * (i % 9), f"s{i % 3}", i, -i, f"c{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target long, mix_copies int, mix_row string")
    plain = df.select("doc_id", "text", "source")
    want = sorted((r.doc_id, r.target, r.mix_copies) for r in mixed(plain).collect())
    got = mixed(df)
    assert got.columns == ["doc_id", "text", "source", "mix_row", "mix_size", "source_size", "target", "mix_copies"]
    assert sorted((r.doc_id, r.target, r.mix_copies) for r in got.collect()) == want
    out = emitted(df)
    assert out.columns == df.columns and all((r.target, r.mix_copies) == (r.doc_id, -r.doc_id) for r in out.collect())
