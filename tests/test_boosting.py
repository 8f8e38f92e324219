"""Boosted trees from counted rows against Spark's own, and pricing of sessions where they lie."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tallyspark.operators import boosting as BO
from tallyspark.operators import chain as CH
from tallyspark.plans import fitted as P


def table(spark, n, copies=1):
    r = np.random.default_rng(3)
    x = np.stack([r.integers(0, 30, n), r.integers(0, 7, n), r.integers(0, 25, n) / 8, np.full(n, 2)], axis=1)
    y = r.random(n) < 1 / (1 + np.exp(1.5 - 0.1 * x[:, 0] + 0.3 * (x[:, 1] > 3) * x[:, 2]))
    rows = [(*map(float, a), int(b)) for a, b in zip(x, y, strict=True)]
    return spark.createDataFrame(rows, "a double, b double, c double, d double, y int").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))


FEATURES = ["a", "b", "c", "d"]


@pytest.mark.parametrize("copies", [1, 3])
def test_the_model_is_that_of_sparks_own_boosting(spark, copies):
    df = table(spark, 3000, copies)
    x = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(df)
    want = GBTClassifier(featuresCol="x", labelCol="y", maxIter=12, maxDepth=4, stepSize=0.3, subsamplingRate=1.0).fit(x)
    got = BO.fit(df, FEATURES, "y", 12, 4, 0.3, 1.0).setFeaturesCol("x")
    assert got.treeWeights == want.treeWeights and got.numFeatures == want.numFeatures == 4
    ours, theirs = ([r.probability[1] for r in m.transform(x.orderBy(*FEATURES, "y")).collect()] for m in (got, want))
    assert np.allclose(ours, theirs, atol=1e-4)
    assert got.featureImportances.toArray() == pytest.approx(want.featureImportances.toArray(), abs=1e-3)


@pytest.mark.parametrize("copies", [1, 2])
def test_trees_do_not_depend_on_how_rows_are_dealt(spark, monkeypatch, copies):
    df = table(spark, 2500, copies)
    one, at = BO.grow_trees(df, FEATURES, "y", 5, 4, 0.2, 0.8)
    monkeypatch.setattr(BO, "BLOCK_ROWS", 400)
    monkeypatch.setattr(BO, "ROUNDS_KEPT", 2)
    many, again = BO.grow_trees(df.repartition(5, "c"), FEATURES, "y", 5, 4, 0.2, 0.8)
    assert all((a == b).all() for a, b in zip(at, again, strict=True))
    for a, b in zip(one, many, strict=True):
        for part in ("feature", "bin", "value", "rows"):
            assert (getattr(a, part) == getattr(b, part)).all()
    # Each round takes its share anew.
    taken = [t.rows[0] / (2500 * copies) for t in one]
    assert len(set(taken)) > 1 and np.allclose(taken, 0.8, atol=0.05)


def test_edges_are_exact_quantiles(spark):
    r = np.random.default_rng(5)
    values = np.sort(r.normal(size=4000))
    df = spark.createDataFrame([(float(v), float(i % 3)) for i, v in enumerate(r.permutation(values))], "a double, b double")
    many, few = BO.edges(df, ["a", "b"])
    at = np.arange(1, BO.BINS) * 4000 // BO.BINS
    assert np.allclose(many, (values[at] + values[at - 1]) / 2, atol=1e-15) and few.tolist() == [0.5, 1.5]


def test_no_rows_cannot_be_fitted(spark):
    with pytest.raises(ValueError, match="no rows"):
        BO.fit(table(spark, 10).where("false"), FEATURES, "y", 2, 2, 0.1, 1.0)


def test_chances_of_states_equal_the_model(spark):
    df = table(spark, 400)
    model = BO.fit(df, FEATURES, "y", 15, 4, 0.2, 0.9)
    x = np.array([[r.a, r.b, r.c, r.d] for r in df.collect()])
    want = [r.probability[1] for r in model.setFeaturesCol("x").transform(VectorAssembler(inputCols=FEATURES, outputCol="x").transform(df)).collect()]
    read = type(model)(model._java_obj)
    for leaves in (BO.Leaves.of(model), BO.Leaves.of(read)):
        fixed = leaves.left_over({f: leaves.bins(f, x[:, f]) for f in (0, 3)}, len(x))
        states = leaves.left_over({f: leaves.bins(f, x[:, f]) for f in (1, 2)}, len(x))
        own = np.arange(len(x))[:, None]
        assert np.allclose(leaves.chances(fixed, states, own)[:, 0], want, atol=1e-12)  # a state a row
        shared = leaves.chances(fixed, states[:3], np.tile(np.arange(3), (len(x), 1)))  # three states for all
        assert np.allclose(shared, np.stack([leaves.chances(fixed, states, np.full((len(x), 1), k))[:, 0] for k in range(3)], axis=1), atol=1e-12)


def test_a_fit_has_no_jobs_for_each_round_and_starts_are_not_shuffled(spark):
    events = CH.settled(P.session_events(spark, "/root/testdata/sf0.001").where("day IS NOT NULL"))
    jobs = []
    for rounds in (2, 60):
        spark.sparkContext.setJobGroup(f"fit-{rounds}", "")
        model, starts = CH.OutcomeChain(P.FEATURES, P.SESSION, rounds, rounds, size=8).fit_parts(events)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit-{rounds}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] > 0 and jobs[1] - jobs[0] < 20
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert exchanges(model.staged(starts)) == 0
    assert exchanges(model.report(starts)) == 1  # the means
