import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tallyspark.operators import calibration as CAL
from tallyspark.operators import metrics as S
from tallyspark.operators import selection as C
from tallyspark.operators.model import Forest, fit_classifier


def scored(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    p = np.round(rng.uniform(0.02, 0.98, n), 2)
    y = (rng.uniform(size=n) < p**1.5).astype(int)
    return spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y, strict=True)], "p double, y int")


def test_calibrators_improve_a_biased_score(spark):
    df = scored(spark)
    winner, rows = CAL.sweep(df, scored(spark, seed=2))
    loss = {r["name"]: r["log_loss"] for r in rows}
    assert winner != "identity" and min(loss[n] for n in ("isotonic", "platt_1", "beta_1")) < loss["identity"]


def test_isotonic_is_monotone_and_interpolates():
    curve = CAL.Isotonic([0.2, 0.4], [0.1, 0.5])
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    got = [r[0] for r in spark.createDataFrame([(0.0,), (0.2,), (0.3,), (0.4,), (0.9,)], "p double").select(curve.apply(F.col("p"))).collect()]
    assert got == pytest.approx([0.1, 0.1, 0.3, 0.5, 0.5])


def test_count_cdf_calibration(spark):
    rng = np.random.default_rng(4)
    rows = [([0.25, 0.25, 0.25, 0.25], int(rng.integers(0, 4))) for _ in range(50)] + [([0.1 + i / 100, 0.3, 0.3, 0.3 - i / 100], int(rng.integers(0, 4))) for i in range(20)]
    df = spark.createDataFrame(rows, "pmf array<double>, actual int")
    got = df.select(CAL.apply_count_cdf(F.col("pmf"), CAL.fit_count_cdf(df, 4)).alias("q")).collect()
    assert all(sum(r.q) == pytest.approx(1) and min(r.q) >= 0 and len(r.q) == 4 for r in got)


def test_forest_equals_the_model(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(int)
    df = spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y, strict=True)], "a double, b double, c double, y int")
    model = fit_classifier(df, ["a", "b", "c"], "y", rounds=8)
    want = [r.probability[1] for r in model.transform(VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)).collect()]
    assert Forest.of(model).probability(x) == pytest.approx(want)


def test_metrics_with_one_class_and_ties(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.5, 1)], "p double, y int")
    assert S.roc_auc(df).first()[0] == pytest.approx(0.5)
    assert S.average_precision(df).first()[0] == pytest.approx(2 / 3)
    assert S.roc_auc(df.where("y = 1")).first()[0] is None


def test_stakes_respect_every_cap(spark):
    rng = np.random.default_rng(6)
    rows = [(1, g, p, 0.6, 2.0, 0.2 + float(rng.uniform(0, 0.1)), 0.3, 0.03) for g in range(4) for p in range(5)]
    df = spark.createDataFrame(rows, "board int, game_id int, player_id int, prob double, decimal_odds double, ev double, stake_kelly double, uncertainty double")
    got = C.size_stakes(df, "board").toPandas()
    assert got["weight"].sum() <= C.BOARD_CAP + 1e-9 and got["weight"].between(0, C.CAP + 1e-12).all()
    assert (got.groupby("game_id")["weight"].sum() <= C.GAME_CAP + 1e-9).all() and got["weight"].sum() > 0


def test_splits_do_not_overlap(spark):
    df = spark.range(1000).select((F.col("id") % 37).alias("k"), F.col("id").alias("ts"))
    held = C.group_holdout(df, ["k"], "ts")
    a, b = held.where("is_eval").select("k").distinct(), held.where("not is_eval").select("k").distinct()
    assert a.intersect(b).count() == 0 and a.count() == 11 and held.count() == 1000


def test_streaming_equals_batch(spark, tmp_path):
    from tallyspark.operators import market as M
    from tallyspark.plans.views import quote_view
    from tallyspark.streaming import quotes as Q

    source = quote_view(spark, "/root/testdata/sf0.001").select(*Q.KEYS, "over_odds", "under_odds", F.col("snapshot_ts").cast("timestamp").alias("snapshot_ts"))
    source = source.dropDuplicates([*Q.KEYS, "snapshot_ts"]).cache()
    source.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = Q.latest_of_cell(Q.quote_stream(spark, str(tmp_path / "in"), source.schema, late="10000 days"))
    run = stream.writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    batch = M.two_sided(source).groupBy(*Q.KEYS).agg(F.max("snapshot_ts").alias("snapshot_ts"))
    got = spark.table("latest").select(*Q.KEYS, "snapshot_ts")
    assert got.exceptAll(batch).count() == 0 and batch.exceptAll(got).count() == 0


def test_exact_quantiles(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=501), 1)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double").repartition(5)
    qs = [0, 0.1, 0.25, 0.5, 0.9, 1]
    assert S.exact_quantiles(df, "v", qs) == pytest.approx(np.quantile(x, qs).tolist())
    assert S.exact_quantiles(df.where("v > 99"), "v", [0.5]) == [None]


def test_residual_sweep_accepts_only_a_gain(spark):
    rng = np.random.default_rng(9)
    truth = rng.uniform(0.1, 0.9, 4000)
    y = (rng.random(4000) < truth).astype(int)
    frame = lambda p: spark.createDataFrame([(float(a), int(b), 0.5) for a, b in zip(p, y, strict=True)], "p double, y int, market_over_prob double")
    skewed = frame(truth**3)
    accepted, chosen, rows = CAL.residual_sweep(skewed, skewed)
    by_name = {r["name"]: r for r in rows}
    q = np.clip(truth**3, 1e-6, 1 - 1e-6)
    assert accepted and chosen != "current" and len(rows) == 9 and set(CAL.RESIDUAL_METRICS) <= set(rows[0])
    assert by_name["current"]["log_loss"] == pytest.approx(-np.mean(y * np.log(q) + (1 - y) * np.log(1 - q)))
    assert by_name["current"]["market_brier"] == pytest.approx(0.25) and by_name["current"]["delta_brier"] == pytest.approx(0.25 - np.mean((q - y) ** 2))
    flat = spark.createDataFrame([(0.5, i % 2, 0.5) for i in range(400)], "p double, y int, market_over_prob double")
    assert CAL.residual_sweep(flat, flat)[:2] == (False, "current")
    assert CAL.residual_sweep(flat, flat.where("p > 1"))[0] is False
