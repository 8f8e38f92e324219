import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyspark.operators.matching import match_games, match_names
from tallyspark.sources import scans, sinks
from tallyspark.sources.paged import PagedJson


def event(i, price):
    outcomes = [{"name": "Over", "description": "A B", "point": 4.5, "price": price}, {"name": "Under", "description": "A B", "point": 4.5, "price": -120}, {"name": "Over", "description": "A B", "point": 4.5, "price": price + 5}]
    return {"id": f"e{i}", "commence_time": "2024-04-01T17:05:00Z", "home_team": "H", "away_team": "A", "bookmakers": [{"key": "v1", "title": "V", "last_update": "2024-04-01T16:00:00Z", "markets": [{"key": "k", "outcomes": outcomes}]}]}


def test_json_archive(spark, tmp_path):
    (tmp_path / "odds_2024-04-01T163000Z.json").write_text(json.dumps([event(1, 100), event(2, 110)]))
    (tmp_path / "odds_20240402_120000.json").write_text(json.dumps(event(3, 120)))
    (tmp_path / "bad_20240402_130000.json").write_text("{not json")
    got = {r.event_id: r for r in scans.normalise_quotes(scans.json_archive(spark, str(tmp_path))).collect()}
    assert set(got) == {"e1", "e2", "e3"}
    assert (got["e1"].over_odds, got["e1"].under_odds, got["e1"].player_name, got["e1"].line_value) == (105.0, -120.0, "A B", 4.5)
    assert got["e1"].fetched_at == datetime(2024, 4, 1, 16, 30) and got["e3"].fetched_at == datetime(2024, 4, 2, 12)


def test_snapshot_union(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir(), b.mkdir()
    rows = spark.createDataFrame([("e1", "2024-04-01 10:00:00", "2024-04-01 17:00:00", "x", 100.0)], "event_id string, updated_at string, commence_time string, line_value string, over_odds double")
    rows.toPandas().to_parquet(a / "one.parquet")
    (b / "two.csv").write_text("event_id,updated_at,commence_time,line_value\ne2,2024-04-01 18:00:00,2024-04-01 17:00:00,4.5\n")
    got = {r.event_id: r for r in scans.snapshot_union(spark, [str(a), str(b), str(tmp_path / "none")]).collect()}
    assert got["e1"].line_value is None and got["e1"].is_live_snapshot == 0 and str(got["e1"].snapshot_date) == "2024-04-01"
    assert got["e2"].line_value == 4.5 and got["e2"].is_live_snapshot == 1
    empty = scans.snapshot_union(spark, [str(tmp_path / "none")])
    assert empty.columns == scans.QUOTE_SCHEMA.names and empty.count() == 0
    assert scans.parquet_or_empty(spark, str(tmp_path / "none.parquet"), scans.QUOTE_SCHEMA).count() == 0


def test_paged_source(spark, tmp_path):
    (tmp_path / "page").write_text(json.dumps({"data": [{"a": 1}, {"a": 2}], "meta": {"next_cursor": None}}))
    spark.dataSource.register(PagedJson)
    got = spark.read.format("paged_json").option("urls", f"file://{tmp_path}/page file://{tmp_path}/page").load()
    assert sorted(r.a for r in got.select(F.from_json("record", "a int").alias("r")).select("r.a").collect()) == [1, 1, 2, 2]


def test_paged_reader_follows_cursors():
    reader = PagedJson({"urls": "u", "token": "t"}).reader(None)
    pages = {"u": {"data": [1], "meta": {"next_cursor": "x y"}}, "u?cursor=x+y": {"data": [2], "meta": {}}}
    reader._get = pages.__getitem__
    assert [r[1:] for r in reader.read(reader.partitions()[0])] == [(0, "1"), (1, "2")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, None, 5)], "k int, s string, ref int")
    sinks.write_csv(df, str(tmp_path / "c"), single=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    assert sinks.write_json_summary(df.agg(F.count(F.lit(1)).alias("n")), str(tmp_path / "j")) == {"n": 2}
    assert sinks.markdown_table(df.orderBy("k")).splitlines()[2] == "| 1 | a |  |"
    sinks.write_resolved(df, "ref", str(tmp_path / "r"))
    assert [spark.read.parquet(str(tmp_path / "r" / x)).count() for x in ("resolved", "unresolved")] == [1, 1]
    sinks.write_parquet(df, str(tmp_path / "p"), "k")
    assert spark.read.parquet(str(tmp_path / "p")).where("k = 1").count() == 1


def test_matching(spark):
    left = spark.createDataFrame([(1, "Ann Lee"), (2, "ann lee jr."), (3, "Bob"), (4, None), (5, "Zed")], "id long, name string")
    registry = spark.createDataFrame([(10, "Ann Lee", 2), (11, "ANN LEE", 1), (12, None, 0)], "ref_id long, ref_name string, rank int")
    overrides = spark.createDataFrame([(3, 99), (1, 98)], "id long, ref_id long")
    got = {r.id: (r.ref_id, r.method) for r in match_names(left, registry, overrides).collect()}
    assert got == {1: (10, "exact"), 2: (11, "normalised"), 3: (99, "override"), 4: (None, None), 5: (None, None)}


def test_game_fallback_only_without_any_game(spark):
    games = spark.sql("SELECT * FROM VALUES (1, DATE'2024-01-02', array('a','b')), (2, DATE'2024-01-03', array('c')), (3, DATE'2024-01-05', array('a')) AS t(game_id, day, teams)")
    quotes = spark.sql("SELECT * FROM VALUES (DATE'2024-01-02', 'a'), (DATE'2024-01-03', 'a'), (DATE'2024-01-04', 'a'), (DATE'2024-01-04', 'c'), (DATE'2024-01-01', 'b') AS t(day, team)")
    got = {(str(r.day), r.team): r.game_id for r in match_games(quotes, games).collect()}
    assert got == {("2024-01-02", "a"): 1, ("2024-01-03", "a"): None, ("2024-01-04", "a"): 3, ("2024-01-04", "c"): 2, ("2024-01-01", "b"): 1}


def test_paged_filters_and_batches():
    options = {"urls": "u v?x=1", "params": json.dumps({"seasons[]": [2023, 2024], "player_ids[]": [1, 2, 3, 4, 5], "postseason": False, "sort_by": "a b"}), "split": json.dumps({"seasons[]": 1, "player_ids[]": 2})}
    urls = [p.value for p in PagedJson(options).reader(None).partitions()]
    assert len(urls) == 2 * 2 * 3 and urls[0] == "u?seasons[]=2023&player_ids[]=1&player_ids[]=2&postseason=false&sort_by=a+b"
    assert urls[-1] == "v?x=1&seasons[]=2024&player_ids[]=5&postseason=false&sort_by=a+b"
    whole = PagedJson({"urls": "u", "params": '{"ids[]": [1, 2]}'}).reader(None)
    assert [p.value for p in whole.partitions()] == ["u?ids[]=1&ids[]=2"]


def test_a_failed_page_is_asked_for_again():
    """From its own cursor: the pages before it are not read twice."""
    reader = PagedJson({"urls": "u", "wait": "0"}).reader(None)
    pages = {"u": {"data": [1], "meta": {"next_cursor": 7}}, "u?cursor=7": {"data": [2], "meta": {}}}
    asked = []

    def get(url):
        asked.append(url)
        if asked.count("u?cursor=7") in (1, 2) and url != "u":
            raise OSError("no answer")
        return pages[url]

    reader._get = get
    assert [r[1:] for r in reader.read(reader.partitions()[0])] == [(0, "1"), (1, "2")]
    assert asked == ["u", "u?cursor=7", "u?cursor=7", "u?cursor=7"]
    asked.clear()
    reader.attempts = 2
    with pytest.raises(OSError, match="no answer"):
        list(reader.read(reader.partitions()[0]))


def test_filters_on_the_query_are_pushed_down(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"p{k}").write_text(json.dumps([{"a": k}]))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedJson)
    urls = [f"file://{tmp_path}/p{k}" for k in range(3)]
    got = spark.read.format("paged_json").option("urls", f"{urls[0]} {urls[1]} file://{tmp_path}/missing").option("attempts", "1").option("pushdown", "true").load()
    assert [r.record for r in got.where(F.col("url") == urls[1]).collect()] == ['{"a": 1}']
    assert sorted(r.record for r in got.where(F.col("url").isin(urls[:2])).collect()) == ['{"a": 0}', '{"a": 1}']
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_empty_typed_snapshot(spark, tmp_path):
    from tallyspark.sources.paged import typed

    (tmp_path / "none").write_text(json.dumps({"data": []}))
    spark.dataSource.register(PagedJson)
    schema = spark.createDataFrame([], "a int, b array<string>").schema
    records = spark.read.format("paged_json").option("urls", f"file://{tmp_path}/none").load()
    sinks.write_parquet(typed(records, schema), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 0 and back.schema.simpleString() == schema.simpleString()


def test_stream_of_pages_goes_on_at_its_cursors(spark, tmp_path):
    """Batches continue where those before ended, also after a restart from the checkpoint; replays give the same rows."""
    reader = PagedJson({"urls": "u v", "wait": "0"}).simpleStreamReader(None)
    pages = {"u": {"data": [1, 2], "meta": {"next_cursor": "b"}}, "u?cursor=b": {"data": [3], "meta": {}}, "v": {"data": [9], "meta": {}}}
    reader._get = pages.__getitem__
    first, at = reader.read(reader.initialOffset())
    assert sorted(r[2] for r in first) == ["1", "2", "9"] and at["v"]["done"] and at["u"] == {"page": 1, "cursor": "b", "done": False}
    second, end = reader.read(at)
    assert [r for r in second] == [("u", 1, "3")] and all(x["done"] for x in end.values()) and list(reader.read(end)[0]) == []
    assert sorted(reader.readBetweenOffsets(reader.initialOffset(), end)) == [("u", 0, "1"), ("u", 0, "2"), ("u", 1, "3"), ("v", 0, "9")]

    (tmp_path / "p").write_text(json.dumps({"data": [{"a": 1}], "meta": {}}))
    spark.dataSource.register(PagedJson)
    stream = spark.readStream.format("paged_json").option("urls", f"file://{tmp_path}/p").load()
    for _ in range(2):
        run = stream.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="0 seconds").start()
        run.processAllAvailable()
        run.stop()
    assert [r.record for r in spark.read.parquet(str(tmp_path / "o")).collect()] == ['{"a": 1}']
