"""Evaluation rows, market views, fits on grids, and model diagnostics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import odds as O
from ..functions import pmf as PMF
from . import market as M

#: Fixed grids.
TEMPERATURES = tuple(round(0.70 + 0.05 * i, 2) for i in range(17))
TAUS = tuple(round(0.70 + 0.05 * i, 2) for i in range(15))
LAMBDAS = tuple(round(-0.30 + 0.025 * i, 3) for i in range(25))


def evaluation_rows(main_lines: DataFrame) -> DataFrame:
    """One row for each main line: both sides' probabilities, edges, values, fair odds, and both forecasts' scores."""
    p, m, y = F.col("model_over_prob"), F.col("market_over_prob"), F.col("over_hit")
    return M.candidates(M.labels(main_lines)).withColumns({
        "market_under_prob": 1 - m, "model_under_prob": 1 - p, "market_dist_from_50": F.abs(m - 0.5), "over_edge": p - m, "under_edge": m - p,
        "fair_over": O.fair_odds(p), "fair_under": O.fair_odds(1 - p), "model_log_loss_over": O.log_loss(p, y), "market_log_loss_over": O.log_loss(m, y),
        "model_brier_over": O.brier(p, y), "market_brier_over": O.brier(m, y),
    })


def market_history(quotes: DataFrame) -> DataFrame:
    """Both sides of labelled quotes with what was realised: gap, edge, value, won and profit."""
    sides = M.sides(M.labels(M.two_sided(quotes))).where("odds IS NOT NULL")
    won = F.when(F.col("side") == "over", F.col("over_hit")).otherwise(F.col("under_hit"))
    gap = F.abs(F.col("prob") - F.col("market"))
    return sides.withColumns({"won": won, "abs_gap": gap, "uncertainty": gap, "vendor_count": F.lit(1), "is_live": (F.col("snapshot_ts") >= F.col("commence_time")).cast("int"), "realised": F.when(won == 1, O.profit(F.col("odds"))).otherwise(-1.0)})


def market_view(quotes: DataFrame, priors: DataFrame) -> DataFrame:
    """Per (game_id, player_id): the prior pmf pooled to the consensus, and how far the market moves it."""
    lines = M.consensus(quotes).groupBy("game_id", "player_id").agg(
        F.max("vendor_count").cast("double").alias("vendor_count"), F.count(F.lit(1)).cast("double").alias("threshold_count"), F.avg("consensus_std").alias("mean_vendor_std"),
        F.array_sort(F.collect_list(F.struct(F.col("line_value").alias("line"), F.col("consensus_over").alias("over")))).alias("targets"),
    )
    pooled = M.entropy_pool(priors.select("game_id", "player_id", "pmf").join(lines, ["game_id", "player_id"]))
    root = F.zip_with("pmf", "pooled", lambda a, b: F.pow(F.sqrt(a) - F.sqrt(b), 2.0))
    market, prior = PMF.mean(F.col("pooled")), PMF.mean(F.col("pmf"))
    return pooled.withColumns({"market_mean": market, "prior_mean": prior, "mean_shift": F.abs(market - prior), "divergence": 0.5 * PMF.total(root)}).drop("targets")


def _grid(df: DataFrame, **values: Sequence[float]) -> DataFrame:
    grid = df.sparkSession.range(1)
    for name, steps in values.items():
        grid = grid.withColumn(name, F.explode(F.array(*map(F.lit, steps))))
    return df.crossJoin(F.broadcast(grid.drop("id")))  # a fixed grid of constants


def temperature_scores(df: DataFrame, steps: Sequence[float] = TEMPERATURES) -> DataFrame:
    """(temperature, log_score) of a table (pmf, actual): mean -ln of the tempered chance of the actual count."""
    q = F.coalesce(F.try_element_at(PMF.temperature(F.col("pmf"), F.col("temperature")), F.col("actual").cast("int") + 1), F.lit(0.0))
    return _grid(df.select("pmf", "actual"), temperature=steps).groupBy("temperature").agg(F.avg(-F.log(F.greatest(q, F.lit(1e-12)))).alias("log_score"))


def best_temperature(df: DataFrame) -> float:
    return temperature_scores(df).agg(F.min_by("temperature", F.struct("log_score", "temperature"))).first()[0]


def tilt_scores(df: DataFrame, taus: Sequence[float] = TAUS, lambdas: Sequence[float] = LAMBDAS) -> DataFrame:
    """(tau, lam, log_loss, brier) of a table (pmf, line_value, over_hit), each row counted `weight` times if it has that.

    Rows with one distribution, line and outcome are the same to every cell of the grid, so they are counted first.
    """
    times = F.sum("weight") if "weight" in df.columns else F.count(F.lit(1))
    counted = df.groupBy("pmf", "line_value", "over_hit").agg(times.cast("double").alias("weight"))
    over = PMF.tilted_over(F.col("logs"), F.col("tau"), F.col("lam"), F.col("line_value"))
    scored = _grid(counted.select(PMF.logs(F.col("pmf")).alias("logs"), "line_value", "over_hit", "weight"), tau=taus, lam=lambdas).select("tau", "lam", over.alias("q"), "over_hit", "weight")
    losses = scored.select("tau", "lam", "weight", O.log_loss(F.col("q"), F.col("over_hit")).alias("log_loss"), O.brier(F.col("q"), F.col("over_hit")).alias("brier"))
    mean = lambda c: (F.sum(F.col(c) * F.col("weight")) / F.sum(F.when(F.col(c).isNotNull(), F.col("weight")))).alias(c)
    return losses.groupBy("tau", "lam").agg(mean("log_loss"), mean("brier"))


def fit_tilt(calibration: DataFrame, evaluation: DataFrame, tolerance: float = 1e-4) -> dict:
    """The cell with the least (calibration log loss, Brier), and whether it beats no tilt on evaluation rows by the tolerance in both."""
    best = tilt_scores(calibration).orderBy("log_loss", "brier", "tau", "lam").first()
    found = {(r.tau, r.lam): r for r in tilt_scores(evaluation, [best.tau, 1.0], [best.lam, 0.0]).collect()}
    base, new = found[1.0, 0.0], found[best.tau, best.lam]
    return {"tau": best.tau, "lam": best.lam, "accepted": base.log_loss - new.log_loss > tolerance and base.brier - new.brier > tolerance}


def randomised_pit(df: DataFrame, seed: int = 42) -> DataFrame:
    """Adds p: uniform between the CDF before and at the actual count, drawn by a hash of the key `id`."""
    c = PMF.cdf(F.col("pmf"))
    a = F.col("actual").cast("int")
    before, at = F.when(a > 0, F.try_element_at(c, a)).otherwise(0.0), F.coalesce(F.try_element_at(c, a + 1), F.lit(1.0))
    u = F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11) / F.lit(float(2**53))
    return df.withColumn("p", F.coalesce(before, F.lit(1.0)) + u * (at - F.coalesce(before, F.lit(1.0))))


def kolmogorov_p_value(statistic: float, n: int) -> float:
    """Asymptotic p-value of the two-sided test."""
    import math

    x = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * statistic
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)))) if x > 0.2 else 1.0


def permutation_importance(df: DataFrame, features: Sequence[str], score: Callable[[DataFrame], float], key: str, repeats: int = 5) -> DataFrame:
    """(feature, importance): mean rise of `score` (a loss) when the feature's values are dealt anew over the rows.

    Each repeat pairs every row with its successor in a seeded hash order of all rows, in ranges, so no task sorts all.
    """
    base = score(df)
    rows = []
    for f in features:
        rises = []
        for seed in range(repeats):
            h = F.xxhash64(key, F.lit(seed))
            dealt = df.repartitionByRange(h).withColumn("_h", h).withColumn("_part", F.spark_partition_id())
            ring = Window.partitionBy("_part").orderBy("_h", key)
            moved = F.coalesce(F.lead(f).over(ring), F.first(f).over(ring))
            rises.append(score(dealt.withColumn(f, moved).drop("_h", "_part")) - base)
        rows.append((f, sum(rises) / repeats))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def home_flag(row_team: Sequence[Column], home_team: Sequence[Column]) -> Column:
    """1 if the first known team id equals the first known home id as text; 0 when either is unknown."""
    known = lambda cs: F.coalesce(*(c.cast("string") for c in cs))
    return F.coalesce((known(row_team) == known(home_team)).cast("int"), F.lit(0))
