"""Candidates, holdout guards, pitch arrays, priors and names on small tables worked out by hand."""

import math

import pytest

from pyspark.sql import functions as F

from tallyspark.operators import features as X
from tallyspark.operators import market as M
from tallyspark.operators import matching as MT
from tallyspark.operators import selection as C


def implied(odds):
    return 100 / (odds + 100) if odds > 0 else -odds / (100 - odds)


def fair(over, under):
    return implied(over) / (implied(over) + implied(under))


def test_candidate_uncertainty(spark):
    rows = [
        (1, 1, "a", 4.5, -110, -110, 0.6), (1, 1, "b", 4.5, 120, -140, 0.6), (1, 1, "c", 4.5, 130, None, 0.6),
        (1, 1, "a", 5.5, 150, None, 0.4),  # no market price
        (1, 1, "a", None, 150, -150, 0.4),
    ]
    df = spark.createDataFrame(rows, "game_id long, player_id long, vendor string, line_value double, over_odds int, under_odds int, model_over_prob double")
    got = {(r.vendor, r.line_value, r.bet_side): r for r in M.board_candidates(df, live=True).collect()}
    assert len(got) == 6
    prices = [fair(-110, -110), fair(120, -140)]
    market, std = sum(prices) / 2, abs(prices[0] - prices[1]) / math.sqrt(2)
    base = 0.01 + (std + 0.0) / 2
    r = got[("c", 4.5, "over")]
    assert (r.vendor_count, r.is_live) == (3, 1)
    assert r.market_prob == pytest.approx(market) and r.edge == pytest.approx(0.6 - market) and r.abs_gap == pytest.approx(abs(0.6 - market))
    assert r.uncertainty == pytest.approx(base + std + abs(0.6 - market))
    under = got[("b", 4.5, "under")]
    assert under.market_prob == pytest.approx(1 - market) and under.edge == pytest.approx(0.4 - (1 - market))
    alone = got[("a", 5.5, "over")]
    assert (alone.market_prob, alone.edge, alone.abs_gap) == (None, 0.4, 0.0) and alone.uncertainty == pytest.approx(base + 0.02)


def test_candidates_need_game_player_and_line(spark):
    rows = [(1, 1, 4.5), (None, 1, 4.5), (1, None, 4.5), (None, None, 4.5), (1, 1, None), (1, 1, math.nan)]
    df = spark.createDataFrame([(g, p, "a", line, -110, -110, 0.6) for g, p, line in rows], "game_id long, player_id long, vendor string, line_value double, over_odds int, under_odds int, model_over_prob double")
    got = M.board_candidates(df).collect()
    # A line that is not a number is still a line.
    assert len(got) == 4 and {(r.game_id, r.player_id) for r in got} == {(1, 1)}


def test_board_candidates_without_players_equal_its_sql(spark, tmp_path):
    import duckdb

    from tallyspark.plans.catalogue import ORACLE_SQL
    from tallyspark.plans.training import board_candidates

    for t, null in (("lineitem", "* REPLACE (CASE WHEN l_orderkey % 5 > 0 THEN l_partkey END AS l_partkey)"), ("orders", "*")):
        duckdb.execute(f"COPY (SELECT {null} FROM '/root/testdata/sf0.001/{t}.parquet') TO '{tmp_path}/{t}.parquet'")
    got = board_candidates(spark, str(tmp_path)).toArrow()
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet'")
    con.register("got", got)
    con.execute(f"CREATE TABLE want AS {ORACLE_SQL['board_candidates']}")
    names = ", ".join(got.column_names)
    assert got.num_rows == con.execute("SELECT count(*) FROM want").fetchone()[0] > 1000
    assert not con.execute(f"SELECT {names} FROM got EXCEPT ALL SELECT {names} FROM want").fetchall()


def test_pregame_by_times_flag_or_neither(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 0), (2, 1), (3, NULL) t(id, is_live_snapshot)")
    assert [r.id for r in M.pregame(df).collect()] == [1]
    assert M.pregame(df.drop("is_live_snapshot")).count() == 3
    timed = df.withColumns({"snapshot_ts": F.col("id"), "commence_time": F.lit(3)})
    assert sorted(r.id for r in M.pregame(timed).collect()) == [1, 2]


def test_guards_of_the_holdout(spark):
    assert [C.guarded_held(n) for n in (20, 33, 50, 85)] == [10, 10, 15, 26]  # 25.5 goes to the even 26
    with pytest.raises(ValueError):
        C.guarded_held(19)
    df = spark.range(60).select((F.col("id") % 30).alias("k"), F.col("id").alias("ts"))
    held = C.guarded_holdout(df, ["k"], "ts")
    assert sorted(r.k for r in held.where("is_eval").select("k").distinct().collect()) == list(range(20, 30))
    with pytest.raises(ValueError):
        C.guarded_holdout(df.where("k < 5"), ["k"], "ts")


def test_pitch_features_of_missing_fields_and_arrays(spark):
    kind = "id int, pitches array<struct<pitch_type_code: string, horizontal_movement: double, is_barrel: boolean, balls: int>>"
    df = spark.createDataFrame([(1, [("FF", 2.0, None, 1), (None, None, None, 2), ("", 4.0, True, 3)]), (2, []), (3, None), (4, [("CH", 1.0, None, None)])], kind)
    a, b, c, d = X.pitch_features(df).orderBy("id").collect()
    assert (a.pitch_count_pa, a.fastball_share_pa, a.avg_horizontal_movement, a.avg_spin_rate, a.last_balls, a.last_is_barrel, a.last_hmov) == (3, 1.0, 3.0, None, 3.0, 1, 4.0)
    assert [tuple(x)[1:] for x in (b,)] == [tuple(x)[1:] for x in (c,)]
    assert (b.pitch_count_pa, b.fastball_share_pa, b.last_is_barrel, b.last_launch_angle) == (0, None, 0, None)
    assert (d.offspeed_share_pa, d.fastball_share_pa, d.last_is_barrel) == (1.0, 0.0, 0)


def test_priors_neither_lose_nor_double_rows(spark):
    frame = spark.createDataFrame([(1, 10, 20, 2024), (2, 11, None, 2024), (3, None, 20, None), (4, 10, 20, 2030)], "event int, pitcher_id int, batter_id int, season int")
    ids = spark.createDataFrame([(10, 100), (10, 90), (11, None), (20, 200), (None, 5)], "player_id int, mlbam_id int")
    pitchers = spark.createDataFrame([(90, 2023, 1.5), (90, 2023, 1.5), (100, 2023, 9.0)], "mlbam_id int, season int, ext_pitcher_x double")
    batters = spark.createDataFrame([(200, 0.5)], "mlbam_id int, ext_batter_y double")
    got = {r.event: (r.ext_pitcher_x, r.ext_batter_y) for r in X.merge_priors(frame, ids, {"pitcher": pitchers, "batter": batters}).collect()}
    assert got == {1: (1.5, 0.5), 2: (None, None), 3: (None, 0.5), 4: (None, 0.5)}
    assert X.merge_priors(frame, ids, {"pitcher": pitchers, "batter": batters}).count() == 4


def test_players_by_folded_name(spark):
    players = spark.createDataFrame([(7, "José O'Neil"), (3, "jose oneil"), (4, None), (5, "--")], "id int, full_name string")
    asked = spark.createDataFrame([(1, "JOSE O’NEIL"), (2, "Jose O Neil"), (3, None), (4, "!!")], "q int, player_name string")
    assert sorted(tuple(r)[::2] for r in MT.match_players(asked, players).collect()) == [(1, 3), (2, None), (3, None), (4, None)]
