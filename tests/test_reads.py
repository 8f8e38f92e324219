"""How often operators read their input, how often they deal it, and rows that are counted before they are worked on."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import calibration as CAL
from tallyspark.operators import diagnostics as D
from tallyspark.operators import market as M
from tallyspark.operators import metrics as S
from tallyspark.operators import selection as C


def counted(spark, df):
    """The table, and a count of the rows that are read from it."""
    read = spark.sparkContext.accumulator(0)

    def seen(frames):
        for frame in frames:
            read.add(len(frame))
            yield frame

    return df.mapInPandas(seen, df.schema), read


def test_learned_filter_reads_its_history_once(spark):
    made = spark.range(400).select(*((F.rand(i) if c not in ("vendor_count", "is_live") else F.lit(1)).alias(c) for i, c in enumerate(C.FILTER_FEATURES)), (F.col("id") % 2).cast("int").alias("won"))
    history, read = counted(spark, made)
    assert C.learned_filter(history, made).count() == 400 and read.value == 400


def test_candidates_are_dealt_once(spark):
    kind = "game_id long, player_id long, vendor string, line_value double, over_odds int, under_odds int, model_over_prob double, snapshot_ts timestamp, l_orderkey long, l_linenumber int, l_suppkey long"
    df = spark.createDataFrame([], kind)
    plan = M.board_candidates(M.latest_quotes(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan


def test_board_candidates_deals_its_tables_once_and_its_quotes_once(spark):
    from tallyspark.plans.training import board_candidates

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = board_candidates(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Lines and orders by order, then the open quotes by player.
    assert plan.count("Exchange ") == 3 and plan.count("SortMergeJoin ") == 1


def test_board_candidates_sorts_its_open_quotes_once(spark):
    from tallyspark.plans.training import board_candidates

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = board_candidates(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The join sorts both sides; one order of the open quotes serves the latest of a cell, its line and its player.
    assert plan.count("Sort [") == 3


def test_tilt_counts_equal_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(rng.dirichlet(np.ones(6)).tolist(), float(rng.integers(1, 4)) + 0.5, int(rng.integers(0, 2)), int(rng.integers(1, 9))) for _ in range(30)]
    df = spark.createDataFrame([*rows, (rows[0][0], 2.5, None, 3), (None, 2.5, 1, 2)], "pmf array<double>, line_value double, over_hit int, weight int")
    single = df.select(F.explode(F.sequence(F.lit(1), "weight")), "pmf", "line_value", "over_hit").drop("col")
    read = lambda t: {(r.tau, r.lam): (r.log_loss, r.brier) for r in D.tilt_scores(t, (0.8, 1.0), (0.0, 0.1)).collect()}
    got, want = read(df), read(single)
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    # By hand, without the grid.
    over = lambda p, line: min(max(sum(x for k, x in enumerate(p) if k > line), 1e-6), 1 - 1e-6)
    assert got[1.0, 0.0][1] == pytest.approx(sum(w * (over(p, line) - y) ** 2 for p, line, y, w in rows) / sum(w for *_, w in rows), abs=1e-9)


def test_holdouts_read_their_rows_twice(spark):
    n = 300
    made = spark.range(n).select((F.col("id") % 60).alias("k"), (F.col("id") * 37 % 101).alias("ts"))
    for hold in (C.group_holdout, C.guarded_holdout):
        df, read = counted(spark, made)
        held = hold(df, ["k"], "ts")
        assert held.where("is_eval").select("k").distinct().count() == 18 and read.value <= 2 * n


def test_gate_choice_reads_its_rows_twice(spark):
    n = 400
    c = F.col("id")
    made = spark.range(n).select(
        (c % 40).alias("game_id"), (c % 80).alias("player_id"), c.alias("snapshot_ts"), F.lit("a").alias("vendor"), F.lit(4.5).alias("line_value"), F.lit("over").alias("best_side"),
        F.lit(0.3).alias("best_ev"), F.lit(0.2).alias("conf_dist"), (c % 10 < 7).cast("int").alias("over_hit"), (c % 10 >= 7).cast("int").alias("under_hit"), F.lit(0.7).alias("model_prob"), F.lit(0.5).alias("market_prob"),
    )
    df, read = counted(spark, made)
    found = C.gate_holdout(df, (0.1, 0.2), (0.0, 0.1))
    assert found["accepted"] and found["test"]["n"] == 120 and read.value <= 2 * n


def test_distance_from_uniform_reads_its_rows_once(spark):
    df, read = counted(spark, spark.range(200).select((F.col("id") % 50 / 50.0).alias("p")))
    assert S.ks_uniform(df).first().ks == pytest.approx(0.02) and read.value == 200


def test_calibrator_sweep_of_counts_equals_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(float(p), int(y), int(w)) for p, y, w in zip(rng.integers(1, 30, 60) / 30.0, rng.integers(0, 2, 60), rng.integers(1, 9, 60), strict=True)]
    df = spark.createDataFrame(rows, "p double, y int, weight int")
    single, read = counted(spark, df.select(F.explode(F.sequence(F.lit(1), "weight")), "p", "y").drop("col"))
    n = sum(w for *_, w in rows)
    (name, got), (same, want) = CAL.sweep(df, df), CAL.sweep(single, single)
    assert name == same and read.value == 2 * n
    for a, b in zip(got, want, strict=True):
        assert a["log_loss"] == pytest.approx(b["log_loss"], abs=1e-7) and a["brier"] == pytest.approx(b["brier"], abs=1e-7)


def test_training_frame_reads_its_events_once(spark):
    from tallyspark.plans import training as T
    from tallyspark.plans.views import pa_view

    events = pa_view(spark, "/root/testdata/sf0.001")
    df, read = counted(spark, events)
    n = events.count()
    assert T.training_frame(df).count() == n and read.value == n
