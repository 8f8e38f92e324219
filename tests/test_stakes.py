import numpy as np
import pandas as pd
import pytest

from tallyspark.operators import selection as C
from tallyspark.operators import stakes as ST


def dense(pdf, cap_board):
    """Projected gradient on the whole covariance matrix, before the caps of games."""
    p, gain, ev = pdf["prob"].to_numpy(), pdf["decimal_odds"].to_numpy() - 1, pdf["ev"].to_numpy()
    cap = np.minimum(C.CAP, np.maximum(0, pdf["stake_kelly"].to_numpy() * (1 - pdf["uncertainty"].to_numpy())))
    s = np.sqrt(np.maximum(p * gain**2 + 1 - p - ev**2, 1e-8))
    same = lambda k: pdf[k].to_numpy()[:, None] == pdf[k].to_numpy()[None]
    corr = np.where(same("player_id"), C.SAME_PLAYER, np.where(same("game_id"), C.SAME_GAME, C.OTHERS))
    np.fill_diagonal(corr, 1)
    cov = corr * np.outer(s, s)
    w, step = np.zeros(len(p)), 1 / np.linalg.eigvalsh(cov).max()
    for _ in range(30_000):
        v = w + step * (ev - cov @ w)
        if np.clip(v, 0, cap).sum() > cap_board:
            low, high = 0.0, v.max()
            for _ in range(70):
                mid = (low + high) / 2
                low, high = (mid, high) if np.clip(v - mid, 0, cap).sum() > cap_board else (low, mid)
            v = v - high
        new = np.clip(v, 0, cap)
        if np.abs(new - w).max() < 1e-15:
            break
        w = new
    held = pdf.assign(w=w).groupby("game_id")["w"].transform("sum").to_numpy()
    return w * np.minimum(1, C.GAME_CAP / np.maximum(held, C.GAME_CAP))


def bets(seed, games, value, shared=False):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(games):
        for k in range(rng.integers(1, 7)):
            player = int(rng.integers(0, 4)) + (0 if shared and rng.random() < 0.3 else 10 * g)
            rows.append((g, player, f"v{k}", float(rng.uniform(0.4, 0.7)), float(rng.uniform(1.6, 2.6)), float(rng.uniform(0.001, value)), float(rng.uniform(0, 0.03)), float(rng.uniform(0, 0.1))))
    return pd.DataFrame(rows, columns=["game_id", "player_id", "vendor", "prob", "decimal_odds", "ev", "stake_kelly", "uncertainty"])


@pytest.mark.parametrize("case", [(1, 8, 0.4, False), (2, 3, 0.01, False), (3, 9, 0.2, True), (4, 1, 0.02, False), (5, 12, 0.004, False)])
def test_equals_the_dense_solution(spark, case):
    seed, games, value, shared = case
    pdf = bets(seed, games, value, shared).assign(board="all")
    got = ST.size_board_stakes(spark.createDataFrame(pdf).repartition(4), "board").toPandas()
    keys = list(pdf.columns)
    both = pdf.assign(want=dense(pdf, C.BOARD_CAP)).merge(got, on=keys)
    assert len(both) == len(pdf) and both["weight"].to_numpy() == pytest.approx(both["want"].to_numpy(), abs=1e-7)
    assert both["stake"].to_numpy() == pytest.approx(both["weight"].to_numpy() * C.BANKROLL)


def test_boards_are_sized_apart_and_the_cap_binds(spark):
    one, two = bets(6, 10, 0.4).assign(board="a"), bets(7, 2, 0.003).assign(board="b")
    got = ST.size_board_stakes(spark.createDataFrame(pd.concat([one, two])), "board", 0.02).toPandas()
    for name, pdf in (("a", one), ("b", two)):
        own = pdf.assign(want=dense(pdf, 0.02)).merge(got, on=list(pdf.columns))
        assert own["weight"].to_numpy() == pytest.approx(own["want"].to_numpy(), abs=1e-7), name
    assert got[got["board"] == "a"]["weight"].sum() == pytest.approx(0.02)
    assert ST.size_board_stakes(spark.createDataFrame(one).limit(0), "board").count() == 0
