import numpy as np
import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from tallyspark.functions import pmf as PMF
from tallyspark.operators import calibration as CAL
from tallyspark.operators import pooling as PO
from tallyspark.operators.model import count_mixture


def rows(spark, seed=3, n=6000):
    rng = np.random.default_rng(seed)
    p = np.round(rng.uniform(0, 1, n), 3)
    g = rng.integers(0, 6, n) * (rng.random(n) > 0.4)  # one group holds half of the rows
    y = (rng.random(n) < p ** (1 + g / 3)).astype(int)
    extra = [(9, 0.5, 1), (9, 0.6, 0), (None, 0.3, 1), (0, None, 1), (0, 0.3, None)]
    return spark.createDataFrame([(int(a), float(b), int(c)) for a, b, c in zip(g, p, y, strict=True)] + extra, "g int, p double, y int")


def test_equals_single_fits(spark):
    df = rows(spark)
    curves = PO.fit_curves(df.repartition(7), ["g"])
    grid = spark.range(0, 1201).select(((F.col("id") - 100) / 1000.0).alias("p"))
    for g in range(6):
        single = CAL.fit_isotonic(df.where(F.col("g") == g))
        both = PO.apply_curves(grid.withColumn("g", F.lit(g)), curves, ["g"]).withColumn("want", single.apply(F.col("p"))).toPandas()
        assert both["q"].to_numpy() == pytest.approx(both["want"].to_numpy())
        model = IsotonicRegression(labelCol="y", featuresCol="p").fit(df.where((F.col("g") == g) & F.col("p").isNotNull() & F.col("y").isNotNull()).selectExpr("p", "double(y) y"))
        assert curves.where(F.col("g") == g).count() == len(model.boundaries) + 1


def test_groups_without_a_curve_keep_their_scores(spark):
    df = rows(spark)
    curves = PO.fit_curves(df, ["g"])
    assert {r.g for r in curves.select("g").distinct().collect()} == set(range(6))
    given = spark.createDataFrame([(9, 0.5), (None, 0.4), (77, 0.3), (0, None), (77, 2.0)], "g int, p double")
    assert [r.q for r in PO.apply_curves(given, curves, ["g"]).orderBy(F.desc_nulls_last("p")).collect()] == [1 - 1e-6, 0.5, 0.4, 0.3, None]
    assert PO.fit_curves(df.where("g > 100"), ["g"]).count() == 0


def test_pool_is_associative():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = rng.integers(2, 60)
        x = np.stack([np.arange(n), np.arange(n), rng.integers(0, 5, n), rng.integers(5, 9, n), np.ones(n)], axis=1).astype(float)
        cut = sorted(rng.integers(0, n, 3))
        parts = np.concatenate([PO.pool(x[a:b]) for a, b in zip([0, *cut], [*cut, n], strict=True)])
        assert np.allclose(PO.pool(parts), PO.pool(x))


def test_plan_holds_no_knots(spark):
    df = rows(spark)
    curves = PO.fit_curves(df, ["g"])
    plan = PO.apply_curves(df, curves, ["g"])._jdf.queryExecution().optimizedPlan().toString()
    knots = [r.at_high for r in curves.where("at_low > 0 AND at_high < 1").limit(20).collect()]
    assert knots and not any(repr(k)[:10] in plan for k in knots)


def test_count_curves_equal_single_fits(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet(np.ones(5), 400)
    data = [(i, p[i].tolist(), int(rng.integers(0, 5)), f"x{i}") for i in range(400)]
    df = spark.createDataFrame(data, "id int, pmf array<double>, actual int, name string")
    got = PO.apply_count_curves(df, PO.fit_count_curves(df, 5), ["id"]).orderBy("id").collect()
    want = df.select("id", CAL.apply_count_cdf(F.col("pmf"), CAL.fit_count_cdf(df, 5)).alias("q")).orderBy("id").collect()
    assert [(r.id, r.name) for r in got] == [(i, f"x{i}") for i in range(400)]
    for a, b in zip(got, want, strict=True):
        assert a.pmf == pytest.approx(b.q, abs=1e-6)


def test_lengths_and_mixture_equal_a_plain_fold(spark):
    rng = np.random.default_rng(5)
    steps, hazards = rng.random((40, 12)), rng.random((40, 12)) * 0.4
    left = np.zeros((40, 13))
    for i in range(40):
        alive = 1.0
        for t in range(12):
            left[i, t + 1] = alive * hazards[i, t]
            alive *= 1 - hazards[i, t]
        left[i, 12] += alive
    df = spark.createDataFrame([(i, s.tolist(), h.tolist()) for i, (s, h) in enumerate(zip(steps, hazards, strict=True))], "id int, s array<double>, h array<double>")
    got = df.select("id", PMF.lengths(F.col("h")).alias("l"), PMF.mixture(F.col("s"), PMF.lengths(F.col("h")), 6).alias("m")).orderBy("id").collect()
    want = count_mixture(steps, left, 6)
    for r in got:
        assert r.l == pytest.approx(left[r.id]) and r.m == pytest.approx(want[r.id])
