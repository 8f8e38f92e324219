"""Registered results without SQL against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_stakes import dense

from tallyspark.operators import diagnostics as D
from tallyspark.operators import market as M
from tallyspark.operators import selection as C
from tallyspark.plans import catalogue as K
from tallyspark.plans import fitted as P
from tallyspark.plans.views import quote_view

DIR = "/root/testdata/sf0.001"


def logistic(x, y, ridge):
    """Newton steps on the mean log loss plus a ridge on the weights; the intercept comes first and is free."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), np.diag([0.0] + [ridge] * (x.shape[1] - 1))
    for _ in range(60):
        q = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x / len(y) + penalty, x.T @ (q - y) / len(y) + penalty @ w)
    return w


def test_platt_fit(spark):
    rows = K.scored(spark, DIR).select("p", "y").toPandas()
    got = {r.p: (r.platt, r.beta) for r in K.QUERIES["platt_fit"](spark, DIR).collect()}
    p, y = np.clip(rows["p"].to_numpy(), 1e-6, 1 - 1e-6), rows["y"].to_numpy()
    inputs = lambda q: (np.log(q / (1 - q))[:, None], np.column_stack([np.log(q), np.log(1 - q)]))
    grid = np.array(sorted(got))
    for k in range(2):
        w = logistic(inputs(p)[k], y, 1 / len(y))
        want = 1 / (1 + np.exp(-(w[0] + inputs(np.clip(grid, 1e-6, 1 - 1e-6))[k] @ w[1:])))
        assert [got[g][k] for g in grid.tolist()] == pytest.approx(np.clip(want, 1e-6, 1 - 1e-6), abs=2e-4)


def test_tilt_fit(spark):
    rows = C.group_holdout(M.labels(M.evaluation_quotes(quote_view(spark, DIR))).join(K._priors(spark, DIR), ["game_id", "player_id"]), ["game_id", "player_id"], "snapshot_ts")
    pdf = rows.select("pmf", "line_value", "over_hit", "is_eval").toPandas()
    a, line, y = np.log(np.maximum(np.array(pdf["pmf"].tolist()), 1e-12)), pdf["line_value"].to_numpy(), pdf["over_hit"].to_numpy()

    def scores(tau, lam, of):
        z = np.exp(a / tau + lam * np.arange(a.shape[1]))
        q = np.clip((z * (np.arange(a.shape[1]) > line[:, None])).sum(1) / z.sum(1), 1e-6, 1 - 1e-6)[of]
        return -np.mean(y[of] * np.log(q) + (1 - y[of]) * np.log(1 - q)), np.mean((q - y[of]) ** 2)

    train, held = ~pdf["is_eval"].to_numpy(), pdf["is_eval"].to_numpy()
    cells = {(t, lam): scores(t, lam, train) for t in D.TAUS for lam in D.LAMBDAS}
    got = K.QUERIES["tilt_fit"](spark, DIR).first()
    best = min(cells.values())
    assert cells[got.tau, got.lam][0] == pytest.approx(best[0], abs=1e-9)
    base, new = scores(1.0, 0.0, held), scores(got.tau, got.lam, held)
    assert got.accepted == (base[0] - new[0] > 1e-4 and base[1] - new[1] > 1e-4)


def test_exact_sample(spark):
    got = K.QUERIES["exact_sample"](spark, DIR).collect()
    every = spark.read.parquet(f"{DIR}/orders.parquet").select("o_orderkey", F.xxhash64("o_orderkey", F.lit(42)).alias("h")).toPandas()
    assert {r.o_orderkey for r in got} == set(every.sort_values(["h", "o_orderkey"])["o_orderkey"].head(500)) and len(got) == min(500, len(every))


def test_board_stakes(spark):
    """The registered board against the dense solution over all its bets."""
    best = C.card(K.evaluated(spark, DIR), C.quote_summary(M.evaluation_quotes(quote_view(spark, DIR))), 1.0, 2, 0.10, None, ties=["vendor", *M.TIES])
    over = F.col("best_side") == "over"
    sided = best.withColumns({"prob": F.when(over, F.col("model_over_prob")).otherwise(1 - F.col("model_over_prob")), "odds": F.when(over, F.col("over_odds")).otherwise(F.col("under_odds"))})
    pdf = C.kelly_columns(sided, "prob", "odds").withColumn("uncertainty", F.lit(0.03)).toPandas()
    keys = ["game_id", "player_id", "vendor", "line_value", "best_side"]
    got = P.board_stakes(spark, DIR).toPandas().merge(pdf.assign(want=dense(pdf, C.BOARD_CAP)), on=keys)
    assert len(got) == len(pdf) and got["weight"].to_numpy() == pytest.approx(got["want"].to_numpy(), abs=2e-6)
    assert got["weight"].sum() == pytest.approx(C.BOARD_CAP, abs=1e-4) or got["weight"].sum() < C.BOARD_CAP


def rising(p, y):
    """(scores, values) of the least-squares rising curve, by pooling neighbours one at a time."""
    blocks = []
    for score in np.unique(p):
        blocks.append([y[p == score].sum(), (p == score).sum(), 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.unique(p), np.concatenate([[s / n] * k for s, n, k in blocks])


def test_fitted_universe_bets(spark):
    """The board's prices by a tilt and a curve found anew, on quotes of earlier years."""
    from tallyspark.operators import frames as FR
    from tallyspark.plans import board as B
    from tallyspark.plans import boards as BO
    from tallyspark.plans.views import pa_view, table

    d = DIR.replace("sf0.001", "sf0.01")  # the smaller one has 15 groups, too few for a holdout
    last = table(spark, d, "events").agg(F.max(F.to_date("ts"))).first()[0]
    before = FR.as_of(pa_view(spark, d).withColumn("day", F.to_date("ts")), "day", F.lit(last)).drop("day")
    states = {r.player_id: np.array(r.pmf) for r in B.distributions(B.states(before)).collect()}
    past = M.labels(M.evaluation_quotes(quote_view(spark, d)).where("year(commence_time) < 2000")).where(F.col("player_id").isin(list(states)))
    rows = past.select("game_id", "player_id", "snapshot_ts", "line_value", "over_hit").toPandas()
    groups = rows.groupby(["game_id", "player_id"])["snapshot_ts"].max().reset_index().sort_values(["snapshot_ts", "game_id", "player_id"])
    held = set(map(tuple, groups[["game_id", "player_id"]].to_numpy()[len(groups) - C.guarded_held(len(groups)) :]))
    is_eval = np.array([(g, k) in held for g, k in zip(rows["game_id"], rows["player_id"], strict=True)])
    a = np.log(np.maximum(np.array([states[k] for k in rows["player_id"]]), 1e-12))
    line, y, cells = rows["line_value"].to_numpy(), rows["over_hit"].to_numpy(), np.arange(a.shape[1])

    def over(logs, lines, tau, lam):
        z = np.exp(logs / tau + lam * cells)
        return np.clip((z * (cells > lines[:, None])).sum(1) / z.sum(1), 1e-6, 1 - 1e-6)

    def scores(tau, lam, of):
        q = over(a[of], line[of], tau, lam)
        return -np.mean(y[of] * np.log(q) + (1 - y[of]) * np.log(1 - q)), np.mean((q - y[of]) ** 2)

    found = {(t, lam): scores(t, lam, ~is_eval) for t in D.TAUS for lam in D.LAMBDAS}
    tilt = min(found, key=lambda c: (*found[c], *c))
    base, new = scores(1.0, 0.0, is_eval), scores(*tilt, is_eval)
    if not (base[0] - new[0] > 1e-4 and base[1] - new[1] > 1e-4):
        tilt = (1.0, 0.0)
    knots, values = rising(over(a[~is_eval], line[~is_eval], *tilt), y[~is_eval])
    bets = BO.fitted_universe_bets(spark, d).toPandas()
    logs = np.log(np.maximum(np.array([states[int(n[1:])] for n in bets["player_name"]]), 1e-12))
    want = np.clip(np.interp(over(logs, bets["line_value"].to_numpy(), *tilt), knots, values), 1e-6, 1 - 1e-6)
    assert len(bets) and bets["model_over_prob"].to_numpy() == pytest.approx(want, abs=2e-6)


def test_entropy_pool(spark):
    """Padded rows against one row at a time."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(40):
        p = rng.dirichlet(np.ones(int(rng.integers(3, 13)))).tolist()
        lines = sorted(rng.choice(np.arange(0.5, 11, 0.5), int(rng.integers(0, 4)), replace=False).tolist())
        rows.append((i, p, None if i == 7 else [(x, None if rng.random() < 0.1 else float(rng.uniform(0.1, 0.9))) for x in lines]))
    df = spark.createDataFrame(rows, "id int, pmf array<double>, targets array<struct<line: double, over: double>>").coalesce(2)
    got = {r.id: r.pooled for r in M.entropy_pool(df).collect()}
    for i, p, lines in rows:
        q = np.array(p)
        asked = sorted((x, o) for x, o in (lines or []) if o is not None)
        for _ in range(100):
            before = q.copy()
            for x, o in asked:
                above = np.arange(q.size) > x
                for part, goal in ((above, o), (~above, 1 - o)):
                    if q[part].sum() > 0:
                        q[part] *= goal / q[part].sum()
                q = np.maximum(q, 1e-12)
                q /= q.sum()
            if np.abs(q - before).max() < 1e-7:
                break
        assert got[i] == pytest.approx(q.tolist(), abs=1e-9)


def test_a_short_history_fits_nothing(spark):
    from tallyspark.plans import boards as BO

    rows = spark.range(60).select((F.col("id") % 3).alias("game_id"), F.lit(1).alias("player_id"), F.col("id").alias("snapshot_ts"), F.lit(1.5).alias("line_value"), (F.col("id") % 2).alias("over_hit"), F.array(F.lit(0.2), F.lit(0.3), F.lit(0.5)).alias("pmf"))
    assert BO.fit_board_curves(rows) == ((1.0, 0.0), None)
    assert BO.fit_board_curves(rows.where("id < 0")) == ((1.0, 0.0), None)
