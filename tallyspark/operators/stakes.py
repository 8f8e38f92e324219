"""Stakes of whole boards, without a task that holds a board.

A board's stakes minimise half their variance less their value under caps of each bet and of the board. Correlations are
one constant between games, so games only meet in two sums: the spread of all stakes and their total. Give the first a
price mu and the second a price lambda, and every game sizes its own bets. The dual is concave in the two prices; each
round is one aggregation over the games, which send their sums and how these move with the prices, and a Newton step of
two numbers a board, kept within what earlier rounds leave open.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lineage import settled
from .selection import BANKROLL, BOARD_CAP, CAP, GAME_CAP, OTHERS, SAME_GAME, SAME_PLAYER

ROUNDS, TOLERANCE = 60, 1e-10
_INNER, _STILL = 20_000, 1e-13


class _Block:
    """The bets of games that share players: stakes at given prices. Memory grows with the bets, not with their square."""

    def __init__(self, pdf: pd.DataFrame) -> None:
        p, gain = pdf["prob"].to_numpy(float), pdf["decimal_odds"].to_numpy(float) - 1
        self.ev = pdf["ev"].to_numpy(float)
        self.cap = np.minimum(CAP, np.maximum(0, pdf["stake_kelly"].to_numpy(float) * np.maximum(0, 1 - pdf["uncertainty"].to_numpy(float))))
        self.spread = np.sqrt(np.maximum(p * gain**2 + (1 - p) - self.ev**2, 1e-8))
        texts = [pdf["game_id"].astype(str), pdf["player_id"].astype(str)]
        self.game, self.player, self.both = (np.unique(k, return_inverse=True)[1] for k in (texts[0], texts[1], texts[0] + "/" + texts[1]))
        top = self.spread / np.linalg.norm(self.spread)
        for _ in range(60):
            top = self.covered(top)
            norm = np.linalg.norm(top)
            top = top / norm
        self.step = 1 / (1.02 * norm)

    def covered(self, w: np.ndarray) -> np.ndarray:
        """The covariance less what all bets of the board share, times w."""
        x = self.spread * w
        of = lambda k: np.bincount(k, x)[k]
        return self.spread * ((SAME_PLAYER - OTHERS) * of(self.player) + (SAME_GAME - OTHERS) * (of(self.game) - of(self.both)) + (1 - SAME_PLAYER) * x)

    def stakes(self, mu: float, lam: float) -> np.ndarray:
        """Accelerated projected gradient with restarts."""
        pull = self.ev - mu * self.spread - lam
        w = y = np.zeros(pull.size)
        t = 1.0
        for _ in range(_INNER):
            new = np.clip(y + self.step * (pull - self.covered(y)), 0, self.cap)
            if np.abs(new - y).max(initial=0) < _STILL:
                return new
            if (y - new) @ (new - w) > 0:
                w, y, t = new, new, 1.0
                continue
            after = (1 + np.sqrt(1 + 4 * t * t)) / 2
            w, y, t = new, new + (t - 1) / after * (new - w), after
        return np.clip(w, 0, self.cap)

    def moves(self, w: np.ndarray) -> np.ndarray:
        """[2, 2]: how the sums of spread and of stakes move with the prices, by conjugate gradients over the free bets."""
        free = (w > 0) & (w < self.cap)
        sides = np.stack([self.spread * free, 1.0 * free])
        out = np.zeros((2, 2))
        for j in range(2):
            x, r = np.zeros(w.size), sides[j].copy()
            d, size = r.copy(), r @ r
            for _ in range(4 * w.size + 4):
                if size < 1e-24:
                    break
                q = np.where(free, self.covered(d), 0.0)
                a = size / (d @ q)
                x, r = x + a * d, r - a * q
                size, last = r @ r, size
                d = r + size / last * d
            out[:, j] = -(sides @ x)
        return out


_SUMS = ("spread", "total", "spread_mu", "spread_lam", "total_mu", "total_lam")


def _sums(board: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block = _Block(pdf)
        mu, lam = float(pdf["_mu"].iloc[0]), float(pdf["_lam"].iloc[0])
        w = block.stakes(mu, lam)
        return pd.DataFrame([[pdf[board].iloc[0], block.spread @ w, w.sum(), *block.moves(w).ravel()]], columns=[board, *_SUMS])

    return run


def _written(pdf: pd.DataFrame) -> pd.DataFrame:
    block = _Block(pdf)
    w = block.stakes(float(pdf["_mu"].iloc[0]), float(pdf["_lam"].iloc[0]))
    held = np.bincount(block.game, w)
    w = w * np.minimum(1.0, GAME_CAP / np.maximum(held, GAME_CAP))[block.game]
    return pdf.drop(columns=["_mu", "_lam", "_block"]).assign(weight=w, stake=w * BANKROLL)


def _blocks(bets: DataFrame, board: str) -> DataFrame:
    """(board, game, _block): games that share a player, directly or through others, have one block."""
    pairs = settled(bets.select(board, F.col("game_id").alias("_game"), F.col("player_id").alias("_player")).distinct())
    labels = pairs.select(board, "_game", F.col("_game").alias("_block")).distinct()
    while True:
        known = pairs.join(labels, [board, "_game"])
        by_player = known.groupBy(board, "_player").agg(F.min("_block").alias("_least"))
        joined = known.join(by_player, [board, "_player"]).groupBy(board, "_game").agg(F.min("_least").alias("_block"), F.max(F.col("_least") < F.col("_block")).alias("_moved"))
        found = settled(joined)
        labels = found.select(board, "_game", "_block")
        if found.where("_moved").isEmpty():
            return labels


def _stepped(state: dict, seen: dict, cap: float) -> tuple[dict, bool]:
    """The next prices of a board from what its games sent for the ones asked, and whether it is done.

    The total falls as lambda rises, so each answer narrows a bracket; a Newton step that leaves it gives way to its middle.
    """
    mu, lam = state["asked"]
    slope = np.array([seen["spread"] - mu / OTHERS, seen["total"] - cap])
    bent = np.array([[seen["spread_mu"] - 1 / OTHERS, seen["spread_lam"]], [seen["total_mu"], seen["total_lam"]]])
    idle = lam <= 0 and slope[1] <= 0
    if abs(slope[0]) < TOLERANCE and (idle or abs(slope[1]) < TOLERANCE):
        return state, True
    low, high = state["low"], state["high"]
    # An answer at a mu that is too low or too high only tells on one side what the best mu would answer.
    if slope[1] > 0 and slope[0] < TOLERANCE:
        low = max(low, lam)
    elif slope[1] <= 0 and slope[0] > -TOLERANCE:
        high = min(high, lam)
    below, above = state["mu"] if state["at"] == lam else (-np.inf, np.inf)
    below, above = (max(below, mu), above) if slope[0] > 0 else (below, min(above, mu))
    alone = mu - slope[0] / bent[0, 0]
    if not below < alone < above and abs(slope[0]) >= TOLERANCE:
        alone = (below + above) / 2
    to = (alone, -1.0)
    if abs(bent[1, 1]) > 1e-12 and not idle:
        move = np.linalg.solve(bent, -slope)
        to = (mu + move[0], lam + move[1])
    if idle or not low < to[1] < high or not np.isfinite(to[0]):
        settled_mu = abs(slope[0]) < TOLERANCE
        middle = (low + high) / 2 if high < np.inf else max(2 * low, 0.05)
        to = (alone, 0.0 if idle else middle if settled_mu else lam)
    return {"asked": to, "low": low, "high": high, "mu": (below, above), "at": lam}, False


def size_board_stakes(selected: DataFrame, board: str, cap: float = BOARD_CAP) -> DataFrame:
    """Adds weight and stake to bets (board, game_id, player_id, prob, decimal_odds, ev, stake_kelly, uncertainty).

    Each board's weights are the optimum under the caps of its bets and of the board; then a game over its cap is scaled
    down to it. A task holds the bets of a game, or of the few that share players. Two prices a board reach the driver.
    """
    spark = selected.sparkSession
    labels = _blocks(selected, board).withColumnRenamed("_game", "game_id")
    bets = settled(selected.join(labels, [board, "game_id"]).select(*selected.columns, "_block"))
    boards = [r[0] for r in bets.select(board).distinct().collect()]
    states = {b: {"asked": (0.0, 0.0), "low": 0.0, "high": np.inf, "mu": (-np.inf, np.inf), "at": -1.0} for b in boards}
    kind = bets.schema[board].dataType
    prices = T.StructType([T.StructField(board, kind), T.StructField("_mu", T.DoubleType()), T.StructField("_lam", T.DoubleType())])
    sent = T.StructType([T.StructField(board, kind), *(T.StructField(c, T.DoubleType()) for c in _SUMS)])

    def priced(which) -> DataFrame:
        # Two numbers a board.
        return bets.join(F.broadcast(spark.createDataFrame([(b, *map(float, states[b]["asked"])) for b in which], prices)), board)

    open_boards = list(boards)
    for _ in range(ROUNDS):
        if not open_boards:
            break
        sums = priced(open_boards).groupBy(board, "_block").applyInPandas(_sums(board), sent).groupBy(board).agg(*(F.sum(c).alias(c) for c in _SUMS))
        still = []
        for r in sums.collect():
            states[r[board]], done = _stepped(states[r[board]], r.asDict(), cap)
            if not done:
                still.append(r[board])
        open_boards = still
    schema = T.StructType([*selected.schema, T.StructField("weight", T.DoubleType()), T.StructField("stake", T.DoubleType())])
    columns = schema.names
    return priced(boards).groupBy(board, "_block").applyInPandas(lambda pdf: _written(pdf)[columns], schema)
