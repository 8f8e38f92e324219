import numpy as np
import pytest
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import functions as F

from tallyspark.operators import chain as CH
from tallyspark.operators import diagnostics as D
from tallyspark.operators.model import count_mixture
from tallyspark.plans import fitted as P

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def chain(spark):
    events = CH.settled(P.session_events(spark, DIR))
    estimator = CH.OutcomeChain(P.FEATURES, P.SESSION, rounds=4, stop_rounds=4, size=8)
    return events, estimator, estimator.fit(events), CH.settled(estimator.parts(events))


def isotonic(p, y):
    """Knots and values by pooling one by one, or None."""
    order = np.argsort(p, kind="stable")
    blocks = []
    for a in np.unique(p[order]):
        blocks.append([a, a, y[p == a].sum(), (p == a).sum()])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            low, _, s, n = blocks[-2]
            _, high, s1, n1 = blocks.pop()
            blocks[-1] = [low, high, s + s1, n + n1]
    if np.unique(p).size < 5:
        return None
    x = [k for b in blocks for k in ((b[0], b[1]) if b[0] < b[1] else (b[0],))]
    v = [b[2] / b[3] for b in blocks for _ in ((0, 1) if b[0] < b[1] else (0,))]
    return np.array(x), np.array(v)


def read(curve, p):
    return np.clip(p if curve is None else np.interp(p, *curve), 1e-6, 1 - 1e-6)


def arrays(model, starts):
    keys = list(P.SESSION)
    steps = CH.step_rows(starts, keys, P.FEATURES, F.sequence(F.lit(1), F.lit(36)))
    rows = CH._scored(CH._scored(steps, model.success, P.FEATURES, "p"), model.stop, [*P.FEATURES, "future_bf_step"], "h")
    pdf = rows.select(*keys, "future_bf_step", "p", "h", "actual").toPandas().sort_values([*keys, "future_bf_step"])
    n = len(pdf) // 36
    return pdf["p"].to_numpy().reshape(n, 36), pdf["h"].to_numpy().reshape(n, 36), pdf["actual"].to_numpy()[::36]


def distributions(p, h, size=8):
    left, alive = np.zeros((len(p), 37)), np.ones(len(p))
    for t in range(36):
        left[:, t + 1] = alive * h[:, t]
        alive = alive * (1 - h[:, t])
    left[:, 36] += alive
    return count_mixture(p, left, size)


def test_report_equals_a_numpy_chain(spark, chain):
    events, _, model, starts = chain
    held, last = starts.where("part = 'calibrate'"), starts.where("part = 'evaluate'")
    rows = CH._scored(events.join(held.select(*P.SESSION), list(P.SESSION)), model.success, P.FEATURES, "p").select("p", "is_strikeout").toPandas()
    periods = CH.step_rows(held, P.SESSION, P.FEATURES, F.sequence(F.lit(1), F.least(F.lit(36), F.col("remaining_bf").cast("int"))))
    ends = CH._scored(periods, model.stop, [*P.FEATURES, "future_bf_step"], "h").selectExpr("h", "int(future_bf_step = remaining_bf) y").toPandas()
    success, stop = isotonic(rows["p"].to_numpy(), rows["is_strikeout"].to_numpy()), isotonic(ends["h"].to_numpy(), ends["y"].to_numpy())

    p, h, actual = arrays(model, held)
    actual = np.minimum(actual, 7)
    base = distributions(read(success, p), read(stop, h))
    curves = [isotonic(np.clip(base[:, : k + 1].sum(axis=1), 1e-6, 1 - 1e-6), (actual <= k).astype(int)) for k in range(7)]

    def by_counts(q):
        c = np.cumsum(q, axis=1)
        c = np.stack([read(curves[k], c[:, k]) for k in range(7)] + [np.ones(len(q))], axis=1)
        c = np.maximum.accumulate(c, axis=1)
        out = np.diff(c, axis=1, prepend=0)
        return out / out.sum(axis=1, keepdims=True)

    def tempered(q, t):
        z = np.maximum(q, 1e-12) ** (1 / t)
        return z / z.sum(axis=1, keepdims=True)

    score = lambda q, a: -np.log(np.maximum(q[np.arange(len(q)), a], 1e-12)).mean()
    best = min(D.TEMPERATURES, key=lambda t: (round(score(tempered(by_counts(base), t), actual), 12), t))
    assert model.temperature == pytest.approx(best)

    p, h, actual = arrays(model, last)
    actual = np.minimum(actual, 7)
    calibrated = distributions(read(success, p), read(stop, h))
    want = [distributions(p, h), calibrated, by_counts(calibrated), tempered(by_counts(calibrated), best)]
    got = {r.stage: (r.n, r.log_score) for r in model.report(last).collect()}
    for stage, q in zip(CH.STAGES, want, strict=True):
        assert got[stage] == (len(actual), pytest.approx(score(q, actual), rel=1e-4))


def test_nothing_is_fitted_on_the_last_days(spark, chain):
    events, estimator, model, starts = chain
    assert starts.count() == starts.select(*P.SESSION).distinct().count() and {r.part for r in starts.select("part").distinct().collect()} == {"train", "calibrate", "evaluate"}
    last = starts.where("part = 'evaluate'").select(*P.SESSION, F.lit(1).alias("_last"))
    changed = events.join(last, list(P.SESSION), "left").withColumn("is_strikeout", F.when(F.col("_last") == 1, 1 - F.col("is_strikeout")).otherwise(F.col("is_strikeout"))).drop("_last")
    other = estimator.fit(CH.settled(changed))
    assert other.temperature == model.temperature
    for name in ("success_curve", "stop_curve", "count_curves"):
        a, b = (sorted(tuple(round(v, 9) for v in r) for r in getattr(m, name).collect()) for m in (model, other))
        assert a == b


def test_the_step_changes_the_hazard(spark, chain):
    events, _, model, starts = chain
    _, h, _ = arrays(model, starts)
    assert (np.ptp(h, axis=1) > 0.01).mean() > 0.9


def test_missing_features_count_as_zero(spark, chain):
    _, _, model, starts = chain
    some = starts.where("part = 'evaluate'").limit(20)
    without = model.transform(some.drop("pitcher_id_is_hit_15"))
    zero = model.transform(some.withColumn("pitcher_id_is_hit_15", F.lit(0.0)))
    a, b = ({(r.day, r.pitcher_id): r.pmf for r in df.collect()} for df in (without, zero))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) and sum(a[k]) == pytest.approx(1) for k in a)


def priced(model, starts):
    return {(r.day, r.pitcher_id): r.pmf for r in model.transform(starts.where("part = 'evaluate'")).collect()}


def test_saved_model_comes_back(spark, chain, tmp_path, monkeypatch):
    _, _, model, starts = chain
    path = str(tmp_path / "model")
    model.save(path)
    loaded = CH.OutcomeModel.load(path)
    want, got = priced(model, starts), priced(loaded, starts)
    assert want.keys() == got.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert loaded.temperature == model.temperature and loaded.of("keys") == list(P.SESSION) and loaded.of("size") == 8

    first = CH.current_version(spark, path)
    monkeypatch.setattr(CH, "point_to", lambda *a: (_ for _ in ()).throw(OSError("cut off")))
    with pytest.raises(OSError, match="cut off"):
        model.save(path)
    assert CH.current_version(spark, path) == first and CH.OutcomeModel.load(path).temperature == model.temperature
    monkeypatch.undo()

    plain = GBTClassificationModel.write
    monkeypatch.setattr(GBTClassificationModel, "write", lambda self: (_ for _ in ()).throw(OSError("half")))
    with pytest.raises(OSError, match="half"):
        model.save(path)
    monkeypatch.setattr(GBTClassificationModel, "write", plain)
    assert CH.current_version(spark, path) == first
    loaded.temperature = 1.25
    loaded.save(path)
    assert CH.current_version(spark, path) != first and CH.OutcomeModel.load(path).temperature == 1.25


def test_report_reads_its_starts_once(spark, chain):
    """All stages are scored from one table of steps."""
    _, _, model, starts = chain
    last = starts.where("part = 'evaluate'").drop("part")
    read = spark.sparkContext.accumulator(0)

    def seen(frames):
        for frame in frames:
            read.add(len(frame))
            yield frame

    assert model.report(last.mapInPandas(seen, last.schema)).count() == 4 and read.value == last.count()


def test_the_registered_report_has_all_rounds(spark, monkeypatch):
    class Rounds(Exception):
        pass

    def stop(self, events):
        raise Rounds(self.of("rounds"), self.of("stopRounds"))

    monkeypatch.setattr(CH.OutcomeChain, "parts", stop)
    with pytest.raises(Rounds) as fitted:
        P.fitted_chain_report(spark, "/root/testdata/sf0.001")
    assert fitted.value.args == (350, 300)
