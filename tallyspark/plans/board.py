"""The board: latest state of each pitcher, its count distribution, and every open quote priced by it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import odds as O
from ..functions import pmf as PMF
from ..operators import features as X
from ..operators import market as M
from ..operators import selection as C

CELLS = 21
PRIOR_RATE = 0.22


def states(events: DataFrame) -> DataFrame:
    """(player_id, rate, expected_bf): the rate over the last 30 events before the latest, and the mean session length."""
    rated = X.rolling_rates(events, "pitcher_id", ["is_strikeout"], [30])
    last = X.latest_row(rated, ["pitcher_id"], [F.col("ts").desc(), F.col("event_id").desc()])
    length = events.groupBy("pitcher_id", "game_id").agg(F.count(F.lit(1)).alias("bf")).groupBy("pitcher_id").agg(F.least(F.lit(36), F.greatest(F.lit(1), F.bround(F.avg("bf")).cast("int"))).alias("expected_bf"))
    return last.select("pitcher_id", F.coalesce("pitcher_id_is_strikeout_30", F.lit(PRIOR_RATE)).alias("rate")).join(length, "pitcher_id").withColumnRenamed("pitcher_id", "player_id")


def distributions(state: DataFrame) -> DataFrame:
    rate = F.least(F.greatest("rate", F.lit(1e-4)), F.lit(0.95))
    return state.withColumn("pmf", PMF.fold_tail(PMF.binomial(rate, F.col("expected_bf")), CELLS))


def board(quotes: DataFrame, events: DataFrame) -> DataFrame:
    """One row for each open quote of a known pitcher, with both sides' value, the strict gate and the tier."""
    priced = M.evaluation_quotes(quotes).drop("model_over_prob").join(distributions(states(events)), "player_id")
    over, under = PMF.over(F.col("pmf"), F.col("line_value")), PMF.under(F.col("pmf"), F.col("line_value"))
    rows = M.candidates(M.labels(priced.withColumn("model_over_prob", over / (over + under))))
    summary = {"k_mean": PMF.mean(F.col("pmf")), **{f"k_p{q}": PMF.quantile(F.col("pmf"), q / 100) for q in (50, 80, 90)}}
    gated = C.with_tier(rows.withColumns(summary)).withColumn("passes_strict_ev_gate", C.strict_gate())
    fair = {"fair_over_odds": O.fair_odds_integer(F.col("model_over_prob")), "fair_under_odds": O.fair_odds_integer(1 - F.col("model_over_prob"))}
    return gated.withColumns(fair).select(
        "game_id", "player_id", "vendor", "line_value", "over_odds", "under_odds", "model_over_prob", "market_over_prob", "best_side", "best_ev",
        "conf_dist", "passes_strict_ev_gate", "action_tier", "fair_over_odds", "fair_under_odds", "k_mean", "k_p50", "k_p80", "k_p90",
    )
