"""Flat props, rows for gates and the p-value of the test of uniformity by hand-written cases."""

import math

import numpy as np
from pyspark.sql import functions as F

from tallyspark.operators import market as M
from tallyspark.operators import metrics as S
from tallyspark.operators import selection as C
from tallyspark.sources import scans as SC


def test_market_quotes(spark):
    texts = [
        '{"game_id": 1, "player_id": 2, "vendor": "v", "prop_type": "t", "line_value": 4.5, "updated_at": "2024", "market": {"type": "over_under", "over_odds": -110.9, "under_odds": 105.9, "odds": 300}}',
        '{"game_id": 1, "player_id": 3, "market": {"type": "milestone", "odds": 250}}',
        '{"game_id": 1, "player_id": 4, "market": null}',
        '{"game_id": null, "player_id": 4}',
        "broken",
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.from_json("t", SC.PROPS_SCHEMA).alias("r")).select("r.*")
    got = sorted(tuple(r) for r in SC.market_quotes(rows, "asked").collect())
    assert got == [(1, 2, "v", "t", 4.5, -110, 105, None, "2024"), (1, 3, "", "asked", 0.0, None, None, 250, None), (1, 4, "", "asked", 0.0, None, None, None, None)]
    assert SC.market_quotes(rows.limit(0), "asked").count() == 0


def test_gate_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, 0.3, 0.6, 0.5, 1, 0.1, None, " Ov"), (1, 0.3, 0.6, 0.5, 1, None, None, "UNDER"), (2, 0.3, 0.6, 0.5, 0, 0.1, 0.2, None), (3, inf, 0.6, 0.5, 1, 0.1, 0.1, "o"), (4, 0.3, nan, 0.5, 1, nan, 0.1, "o"), (5, 0.3, 0.2, None, 1, 0.1, 0.1, "o"), (6, 0.1, 0.2, 0.4, 1, nan, -0.5, "push")]
    df = spark.createDataFrame(rows, "id int, best_ev double, model_over_prob double, market_over_prob double, actual_over int, over_ev double, under_ev double, given string")
    derived = {r.id: (r.side, round(r.model_prob, 6), round(r.market_prob, 6), r.actual, round(r.conf_dist, 6)) for r in C.gate_rows(df).collect()}
    assert derived == {0: ("over", 0.6, 0.5, 1.0, 0.1), 1: ("over", 0.6, 0.5, 1.0, 0.1), 2: ("under", 0.4, 0.5, 1.0, 0.1), 6: ("under", 0.8, 0.6, 0.0, 0.3)}
    given = {r.id: (r.side, r.actual) for r in C.gate_rows(df, "given").collect()}
    assert given == {0: ("over", 1.0), 1: ("under", 0.0)}


def test_kolmogorov_p(spark):
    def plain(d, n):
        x = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
        return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)))) if x > 0.2 else 1.0

    cases = [(d, n) for d in (0.0, 0.01, 0.05, 0.2, 0.9) for n in (1, 30, 1000, 10**6)]
    got = spark.createDataFrame(cases, "d double, n long").select("d", "n", S.kolmogorov_p(F.col("d"), F.col("n")).alias("p")).collect()
    assert all(abs(r.p - plain(r.d, r.n)) < 1e-12 for r in got)
    # The five per cent point of the asymptotic distribution.
    assert abs(plain(1.3581 / 1000, 10**6) - 0.05) < 1e-3


def test_learned_candidates_equal_a_plain_fit(spark):
    """The filter's scores against Newton's method on the earlier candidates."""
    from tallyspark.plans import props as P
    from tallyspark.plans.views import quote_view

    directory = "/root/testdata/sf0.01"
    quotes = M.latest_quotes(M.pregame(quote_view(spark, directory)))
    earlier = F.year("commence_time") < P.FITTED_FROM
    history = P.labelled_candidates(quotes.where(earlier)).select(*C.FILTER_FEATURES, "won").toPandas()
    keys = [*P._CELL_COLS, "bet_side"]
    later = M.board_candidates(quotes.where(~earlier)).select(*keys, *C.FILTER_FEATURES).toPandas()
    got = P.learned_candidates(spark, directory).toPandas()
    assert len(got) == len(later) > 1000 and len(history) > 1000 and set(history["won"]) == {0, 1}

    def matrix(df):
        return np.c_[np.ones(len(df)), df[list(C.FILTER_FEATURES)].fillna(0).to_numpy(float)]

    x, y = matrix(history), history["won"].to_numpy(float)
    w, ridge = np.zeros(x.shape[1]), np.r_[0.0, np.full(x.shape[1] - 1, 2.0)]
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        w -= np.linalg.solve(hessian, x.T @ (p - y) + ridge * w)
    later["score"] = 1 / (1 + np.exp(-matrix(later) @ w))
    order = [*keys, "selection_score"]
    want = later.rename(columns={"score": "selection_score"}).sort_values(order)["selection_score"].to_numpy()
    have = got.sort_values(order)
    assert np.abs(have["selection_score"].to_numpy() - want).max() < 2e-3
    sure = np.abs(have["selection_score"] - 0.55) > 2e-3
    assert (have["selected"] == (have["pass_rules"] & (have["selection_score"] >= 0.55)).astype(int))[sure].all()
