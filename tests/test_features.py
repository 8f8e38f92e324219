from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import text as T
from tallyspark.operators import features as X

SCHEMA = "event_id long, ts timestamp_ntz, game_id long, pitcher_id long, batter_id long, pa_number long, is_strikeout int, is_walk int, is_hit int, is_out int, pitch_count_pa int, v double"


def events(spark, rows):
    made = [(i, datetime(2024, 1, 1 + i // 10, i % 24), g, p, b, i, k, 0, 1 - k, k, 4, v) for i, (g, p, b, k, v) in enumerate(rows)]
    return spark.createDataFrame(made, SCHEMA)


def rows(seed=0, n=60):
    import random

    rng = random.Random(seed)
    return [(i // 20, rng.choice([1, 2]), rng.randint(1, 4), rng.randint(0, 1), rng.choice([None, 1.0, 2.5])) for i in range(n)]


def test_no_feature_sees_its_own_or_a_later_row(spark):
    base = rows()
    changed = [(*r[:3], 1 - r[3], 9.0) if i >= 40 else r for i, r in enumerate(base)]
    build = lambda data: {r.event_id: r for r in X.state_so_far(X.rolling_rates(events(spark, data), "pitcher_id", ["is_strikeout", "v"], [15])).collect()}
    a, b = build(base), build(changed)
    known = [c for c in a[0].asDict() if c not in ("is_strikeout", "is_hit", "is_out", "v")]
    for i in range(41):
        first = {p: min(j for j in range(40, 60) if base[j][1] == p) for p in (1, 2)}
        if i < 40 or i in first.values():
            assert all(a[i][c] == b[i][c] for c in known)


def test_rolling_counts_values_not_rows(spark):
    data = [(0, 1, 1, 1, None if i < 10 else float(i)) for i in range(20)]
    got = {r.event_id: r.pitcher_id_v_15 for r in X.rolling_rates(events(spark, data), "pitcher_id", ["v"], [15]).collect()}
    assert got[14] is None and got[15] == pytest.approx(sum(range(10, 15)) / 5)


def test_compat_state_inherits_the_group_before(spark):
    pdf = events(spark, rows(3)).toPandas().sort_values(["game_id", "pitcher_id", "pa_number", "event_id"])
    want = pdf.groupby(["game_id", "pitcher_id"])["is_strikeout"].cumsum().shift(1).fillna(0).astype(int)
    literal = dict(zip(pdf["event_id"], want, strict=True))
    got = {r.event_id: r.is_strikeout_so_far for r in X.state_so_far_compat(events(spark, rows(3))).collect()}
    assert got == literal


def test_first_and_last_are_per_column(spark):
    df = spark.createDataFrame([(1, 1, None, "a"), (1, 2, 5.0, None), (None, 1, 1.0, "z"), (2, 1, None, None)], "k int, at int, x double, y string")
    assert {tuple(r) for r in X.first_non_null(df, ["k"], ["at"], ["x", "y"]).collect()} == {(1, 5.0, "a"), (2, None, None)}
    assert {tuple(r) for r in X.first_non_null(df, ["k"], ["at"], ["x", "y"], last=True).collect()} == {(1, 5.0, "a"), (2, None, None)}


def test_survival_stops_at_the_horizon(spark):
    df = spark.createDataFrame([(1, 2), (2, 40), (3, 0)], "id int, remaining_bf int")
    got = X.survival_long(df, horizon=3).orderBy("id", "future_bf_step").select("id", "future_bf_step", "stops").collect()
    assert [tuple(r) for r in got] == [(1, 1, 0), (1, 2, 1), (2, 1, 0), (2, 2, 0), (2, 3, 0)]


def test_input_order_does_not_matter(spark):
    df = X.rolling_rates(events(spark, rows(5)), "pitcher_id", ["v"], [15])
    again = X.rolling_rates(events(spark, rows(5)).repartition(7).orderBy(F.rand(1)), "pitcher_id", ["v"], [15])
    assert sorted(map(str, df.collect())) == sorted(map(str, again.collect()))


def test_names_sides_and_results(spark):
    df = spark.createDataFrame([("José  O'Neil-Smith Jr.",), ("A & B III",), (None,)], "n string")
    assert [r[0] for r in df.select(T.registry_name(F.col("n"))).collect()] == ["jose o neil smith", "a and b", None]
    assert [r[0] for r in df.select(T.quote_name(F.col("n"))).collect()] == ["jose oneilsmith jr", "a b iii", None]
    df = spark.createDataFrame([(" Ov",), ("UNDER",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(T.side(F.col("s"))).collect()] == ["over", "under", None, None]
    df = spark.createDataFrame([(" left",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(T.hand(F.col("s"))).collect()] == ["L", None, None]
    df = spark.createDataFrame([("Strikeout swinging",), ("Intentional Walk",), ("Walk",), ("Flyout",), (None,)], "r string")
    got = [tuple(r) for r in df.select(*(c.alias(n) for n, c in T.result_flags(F.col("r")).items())).collect()]
    assert got == [(1, 0, 0, 1), (0, 0, 0, 0), (0, 1, 0, 0), (0, 0, 0, 1), (0, 0, 0, 0)]


def test_pitch_arrays(spark):
    kind = "pitches array<struct<release_speed: double, spin_rate: double, release_extension: double, plate_x: double, plate_z: double, pitch_type_code: string, strike_zone: int, pitch_call: string>>"
    df = spark.createDataFrame([([(90.0, None, 6.0, 0.0, 1.0, "FF", 5, "S"), (None, None, 6.5, 0.0, 1.0, "CH", 12, "B")],), ([],)], kind)
    a, b = df.select(*(c.alias(n) for n, c in X.pitch_summary(F.col("pitches")).items())).collect()
    assert (a.avg_release_speed, a.avg_spin_rate, a.fastball_share_pa, a.zone_rate_pa, a.strikes_seen_pa, a.last_pitch_type_code) == (90.0, None, 0.5, 0.5, 1, "CH")
    assert (b.pitch_count_pa, b.avg_release_speed, b.fastball_share_pa, b.last_release_speed) == (0, None, None, None)


def test_prior_season_never_matches_null(spark):
    left = spark.createDataFrame([(1, 2024), (None, 2024)], "k int, season int")
    right = spark.createDataFrame([(1, 2023, 7.0), (1, 2023, 7.0), (None, 2023, 9.0)], "k int, season int, x double")
    assert sorted((tuple(r) for r in X.prior_season(left, right, ["k"], "season").collect()), key=str) == [(1, 2024, 7.0), (None, 2024, None)]
