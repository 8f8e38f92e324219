"""Quotes of several vendors: latest per cell, consensus, main lines, labels, and their use on a distribution."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import odds as O
from .features import latest_row

CELL = ("game_id", "player_id", "vendor", "line_value")
#: Makes the order of quotes total.
TIES = ("l_orderkey", "l_linenumber", "l_suppkey")


def two_sided(quotes: DataFrame) -> DataFrame:
    """Quotes with valid odds on both sides, and market_over_prob without the margin.

    The filter is on the odds themselves: one on the price would be pushed below joins with its whole formula in it.
    """
    both = quotes.where((F.abs(F.col("over_odds")) >= 100) & (F.abs(F.col("under_odds")) >= 100))
    return both.withColumn("market_over_prob", O.no_vig(F.col("over_odds"), F.col("under_odds")))


def latest_quotes(quotes: DataFrame, keys: Sequence[str] = CELL, ties: Sequence[str] = TIES) -> DataFrame:
    """The latest quote of each cell. Rows are dealt by the first two keys, the game and the player, so that what is worked
    out for a player's lines or joined to a player afterwards finds its rows together and moves none of them again."""
    return latest_row(quotes.repartition(*keys[:2]), keys, [F.col("snapshot_ts").desc_nulls_last(), *(F.col(c).desc_nulls_last() for c in ties)])


def pregame(quotes: DataFrame) -> DataFrame:
    """Quotes from before the start. Without both times those that are not flagged as live; without the flag all of them."""
    if {"snapshot_ts", "commence_time"} <= set(quotes.columns):
        return quotes.where("snapshot_ts < commence_time")
    return quotes.where("is_live_snapshot = 0") if "is_live_snapshot" in quotes.columns else quotes


def evaluation_quotes(quotes: DataFrame, prop_type: str | None = "primary") -> DataFrame:
    """Pregame, two-sided, half-point quotes of one proposition, the latest of each cell."""
    kept = two_sided(pregame(quotes)).where(O.is_half_point(F.col("line_value")))
    if prop_type is not None:
        kept = kept.where(F.col("prop_type") == prop_type)
    return latest_quotes(kept)


def main_lines(quotes: DataFrame, ties: Sequence[str] = TIES) -> DataFrame:
    """For each game, player and vendor the line whose price is closest to even, then the earliest; with the number of candidates."""
    keys = ["game_id", "player_id", "vendor"]
    every = Window.partitionBy(*keys)
    near = quotes.withColumn("distance", F.abs(F.col("market_over_prob") - 0.5)).withColumn("candidates", F.count(F.lit(1)).over(every))
    return latest_row(near, keys, [F.col("distance").asc(), F.col("snapshot_ts").asc(), F.col("line_value").asc(), *(F.col(c).asc() for c in ties)])


def consensus(quotes: DataFrame, keys: Sequence[str] = ("game_id", "player_id", "line_value")) -> DataFrame:
    """Mean and sample deviation (0 for one quote) of the margin-free price, vendors and best odds of each line."""
    return two_sided(quotes).groupBy(*keys).agg(
        F.avg("market_over_prob").alias("consensus_over"), F.coalesce(F.stddev_samp("market_over_prob"), F.lit(0.0)).alias("consensus_std"),
        F.countDistinct("vendor").alias("vendor_count"), F.max("over_odds").alias("best_over_odds"), F.max("under_odds").alias("best_under_odds"),
    )


def labels(quotes: DataFrame, actual: str = "actual_total_k") -> DataFrame:
    """Whether the over hit, the under hit, or the line was pushed; a missing actual gives zeros."""
    hit = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    a, line = F.col(actual), F.col("line_value")
    return quotes.withColumns({"over_hit": hit(a > line), "under_hit": hit(a < line), "push": hit(a == line)})


def candidates(quotes: DataFrame) -> DataFrame:
    """Both sides of each two-sided quote priced by the model; the best side is over unless under's value is higher."""
    p = F.col("model_over_prob")
    priced = two_sided(quotes).withColumns({"over_ev": O.expected_value(p, F.col("over_odds")), "under_ev": O.expected_value(1 - p, F.col("under_odds"))})
    over = F.col("over_ev") >= F.col("under_ev")
    return priced.withColumns({
        "best_side": F.when(over, "over").otherwise("under"), "best_ev": F.greatest("over_ev", "under_ev"),
        "model_prob": F.when(over, p).otherwise(1 - p), "market_prob": F.when(over, F.col("market_over_prob")).otherwise(1 - F.col("market_over_prob")),
        "conf_dist": F.abs(p - 0.5),
    })


def sides(quotes: DataFrame) -> DataFrame:
    """One row for each side of each quote: side, odds, model and market probability, edge, value and Kelly stake."""
    p, m = F.col("model_over_prob"), F.col("market_over_prob")
    rows = F.array(
        F.struct(F.lit("over").alias("side"), F.col("over_odds").alias("odds"), p.alias("prob"), m.alias("market")),
        F.struct(F.lit("under").alias("side"), F.col("under_odds").alias("odds"), (1 - p).alias("prob"), (1 - m).alias("market")),
    )
    long = quotes.withColumn("s", F.explode(rows)).select("*", "s.*").drop("s")
    return long.withColumns({"edge": F.col("prob") - F.coalesce("market", F.lit(0.0)), "ev": O.expected_value(F.col("prob"), F.col("odds")), "stake_kelly": O.kelly(F.col("prob"), F.col("odds"))})


#: The uncertainty that any candidate has, and the gap that counts where a line has no market price.
BASE_UNCERTAINTY, UNPRICED_GAP = 0.01, 0.02
LINE = ("game_id", "player_id", "line_value")
#: The columns of CELL, those of a line first.
OFFER = (*LINE, "vendor")


def board_candidates(quotes: DataFrame, live: bool = False) -> DataFrame:
    """One row for each side that is offered: bet_side, odds, prob, market_prob, edge, ev, uncertainty, vendor_count, abs_gap, is_live.

    The market price is the mean over the vendors of a line that offer both sides; where there is none, market_prob is
    null, the edge is the whole probability and the gap 0. A candidate is as uncertain as its player's lines differ between
    vendors in the mean, and its own line, and as its price is off the market's. Vendors count even if one-sided. Quotes
    without a game, player or line are left out. All of it is worked out on the quotes of one player in one game, vendors
    times lines after latest_quotes(), which lie together: no quote is joined to its line. Quotes in the order of their
    line and vendor, as latest_quotes() by OFFER leaves them, are not sorted again.
    """
    fair = quotes.where(" AND ".join(f"{c} IS NOT NULL" for c in LINE)).withColumn("_fair", O.no_vig(F.col("over_odds"), F.col("under_odds")))
    line = Window.partitionBy(*LINE)
    fair = fair.withColumns({
        "_market": F.avg("_fair").over(line), "_std": F.coalesce(F.stddev_samp("_fair").over(line), F.lit(0.0)),
        "vendor_count": F.size(F.collect_set("vendor").over(line)).cast("long"), "_place": F.row_number().over(line.orderBy("vendor")),
    })
    # Each line counts once in its player's mean.
    own = F.avg(F.when(F.col("_place") == 1, F.col("_std"))).over(Window.partitionBy("game_id", "player_id"))
    fair = fair.withColumn("_base", F.lit(BASE_UNCERTAINTY) + own)
    p, m = F.col("model_over_prob"), F.col("_market")
    rows = F.array(
        F.struct(F.lit("over").alias("bet_side"), F.col("over_odds").alias("odds"), p.alias("prob"), m.alias("market_prob")),
        F.struct(F.lit("under").alias("bet_side"), F.col("under_odds").alias("odds"), (1 - p).alias("prob"), (1 - m).alias("market_prob")),
    )
    long = fair.withColumn("_s", F.explode(rows)).select("*", "_s.*").where(F.col("odds").isNotNull())
    gap = F.abs(F.col("prob") - F.col("market_prob"))
    return long.withColumns({
        "edge": F.col("prob") - F.coalesce("market_prob", F.lit(0.0)), "ev": O.expected_value(F.col("prob"), F.col("odds")),
        "uncertainty": F.col("_base") + F.col("_std") + F.coalesce(gap, F.lit(UNPRICED_GAP)), "abs_gap": F.coalesce(gap, F.lit(0.0)), "is_live": F.lit(int(live)),
    }).drop("_fair", "_market", "_std", "_place", "_base", "_s")


def _pooled(pmfs: list, targets: list, tolerance: float, rounds: int) -> list[list[float]]:
    """All rows at once: cells and lines are padded, and a row that has settled takes no further part."""
    lines = [sorted((t["line"], t["over"]) for t in ([] if ts is None else ts) if t["over"] is not None and t["line"] is not None) for ts in targets]
    cells = np.array([len(p) for p in pmfs], int)
    q = np.zeros((len(pmfs), cells.max(initial=0)))
    goals = np.full((len(pmfs), max(map(len, lines), default=0), 2), np.nan)
    for i, (p, own) in enumerate(zip(pmfs, lines, strict=True)):
        q[i, : cells[i]] = p
        if own:
            goals[i, : len(own)] = own
    places = np.arange(q.shape[1])
    rest = np.arange(len(pmfs))
    for _ in range(rounds):
        if not rest.size:
            break
        now, real = q[rest], places < cells[rest, None]
        before = now.copy()
        for line, over in np.moveaxis(goals[rest], 0, 2):
            asked = ~np.isnan(line)
            above = (places > line[:, None]) & real
            for part, goal in ((above, over), (real & ~above, 1 - over)):
                mass = np.where(part, now, 0.0).sum(axis=1)
                scale = np.divide(goal, mass, out=np.ones_like(mass), where=asked & (mass > 0))
                now = np.where(part, now * scale[:, None], now)
            floor = np.where(real, np.maximum(now, 1e-12), 0.0)
            now = np.where(asked[:, None], floor / np.maximum(floor.sum(axis=1, keepdims=True), 1e-300), now)
        q[rest] = now
        rest = rest[np.abs(now - before).max(axis=1, initial=0) >= tolerance]
    return [row[:n].tolist() for row, n in zip(q, cells, strict=True)]


def entropy_pool(df: DataFrame, tolerance: float = 1e-7, rounds: int = 100) -> DataFrame:
    """Rescales `pmf` (array) until its mass over each line meets the target of `targets` (array of struct line, over).

    Lines in ascending order, null targets skipped; needs the columns id, pmf, targets; adds pooled.
    """
    schema = T.StructType([*df.schema, T.StructField("pooled", T.ArrayType(T.DoubleType()))])

    def pool(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(pooled=_pooled(list(pdf["pmf"]), list(pdf["targets"]), tolerance, rounds))

    return df.mapInPandas(pool, schema)
