import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.functions import pmf as P
from tallyspark.operators.market import entropy_pool
from tallyspark.operators.model import count_mixture


def one(spark, column, a, schema="a array<double>"):
    return spark.createDataFrame([(a,)], schema).select(column).first()[0]


A = lambda: F.col("a")
PMF = [0.1, 0.2, 0.4, 0.25, 0.05]


def test_poisson_binomial(spark):
    assert one(spark, P.poisson_binomial(A()), [0.5, 0.25]) == pytest.approx([0.375, 0.5, 0.125])
    p = [0.1, 0.9, 0.35, 0.6, 0.2]
    want = np.array([1.0])
    for x in p:
        want = np.convolve(want, [1 - x, x])
    got = one(spark, P.poisson_binomial(A()), p)
    assert got == pytest.approx(want.tolist()) and one(spark, P.mean(P.poisson_binomial(A())), p) == pytest.approx(sum(p))
    assert one(spark, P.poisson_binomial(A()), []) == [1.0]


def test_tail_quantiles_and_lines(spark):
    assert one(spark, P.fold_tail(A(), 3), PMF) == pytest.approx([0.1, 0.2, 0.7])
    assert one(spark, P.fold_tail(A(), 7), PMF) == pytest.approx([*PMF, 0, 0])
    assert [one(spark, P.quantile(A(), q), PMF) for q in (0.05, 0.1, 0.5, 0.8, 1.0)] == [0, 0, 2, 3, 4]
    for line in (2.0, 2.5, -1.0, 9.0):
        parts = [one(spark, f(A(), F.lit(line)), PMF) for f in (P.over, P.under, P.push)]
        assert sum(parts) == pytest.approx(1)


def test_tilt_and_temperature(spark):
    assert one(spark, P.tilt(A(), F.lit(1.0), F.lit(0.0)), PMF) == pytest.approx(PMF)
    assert one(spark, P.temperature(A(), F.lit(1.0)), PMF) == pytest.approx(PMF)
    raised = np.exp(np.log(PMF) / 0.8 + 0.2 * np.arange(5))
    assert one(spark, P.tilt(A(), F.lit(0.8), F.lit(0.2)), PMF) == pytest.approx((raised / raised.sum()).tolist())
    assert one(spark, P.normalise(A()), [0.0, 0.0]) is None


def test_scores_and_calibrated_cdf(spark):
    c = np.cumsum(PMF)
    assert one(spark, P.ranked_probability_score(A(), F.lit(3)), PMF) == pytest.approx(np.mean((c - (np.arange(5) >= 3)) ** 2))
    got = one(spark, P.calibrated_from_cdf(A()), [0.3, 0.2, 0.9, 0.8])
    assert got == pytest.approx([0.3, 0.0, 0.6, 0.1])


def test_entropy_pool_meets_targets(spark):
    df = spark.createDataFrame([(1, PMF, [(1.5, 0.6), (2.5, 0.2), (3.5, None)]), (2, PMF, None)], "id long, pmf array<double>, targets array<struct<line: double, over: double>>")
    rows = {r.id: r.pooled for r in entropy_pool(df).collect()}
    assert sum(rows[1][2:]) == pytest.approx(0.6, abs=1e-5) and sum(rows[1][3:]) == pytest.approx(0.2, abs=1e-5)
    assert rows[2] == pytest.approx(PMF)


def test_mixture_equals_its_definition():
    rng = np.random.default_rng(1)
    steps, left = rng.uniform(0, 1, (4, 6)), rng.uniform(0, 1, (4, 7))
    left /= left.sum(axis=1, keepdims=True)
    got = count_mixture(steps, left, 5)
    for i in range(4):
        want = np.zeros(5)
        for n in range(7):
            pb = np.array([1.0])
            for x in steps[i, :n]:
                pb = np.convolve(pb, [1 - x, x])
            folded = np.zeros(5)
            np.add.at(folded, np.minimum(np.arange(pb.size), 4), pb)
            want += left[i, n] * folded
        assert got[i] == pytest.approx(want / want.sum())


def test_tilted_over_is_over_of_the_tilt(spark):
    from pyspark.sql import functions as F

    from tallyspark.functions import pmf as PMF

    df = spark.createDataFrame([([0.1, 0.0, 0.4, 0.5], t, l, x) for t in (0.7, 1.0, 1.4) for l in (-0.3, 0.0, 0.3) for x in (0.5, 2.0, 3.5)], "a array<double>, t double, l double, x double")
    both = df.select(PMF.tilted_over(PMF.logs(F.col("a")), F.col("t"), F.col("l"), F.col("x")).alias("p"), PMF.over(PMF.tilt(F.col("a"), F.col("t"), F.col("l")), F.col("x")).alias("q"))
    assert all(abs(r.p - r.q) < 1e-12 for r in both.collect())
