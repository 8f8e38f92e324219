"""Calibration and scoring metrics of tables with a probability p and an outcome y (0 or 1)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import odds as O
from .lineage import settled


def P() -> Column:
    return F.col("p")


def Y() -> Column:
    return F.col("y")


def scores(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(O.log_loss(P(), Y())).alias("log_loss"), F.avg(O.brier(P(), Y())).alias("brier"))


def _by_score(df: DataFrame) -> DataFrame:
    """Counts of each distinct score: the only table that a total order is made of."""
    return df.groupBy("p").agg(F.sum("y").alias("hits"), F.count(F.lit(1)).alias("n"))


#: Distinct scores of a range on average; small tables still have LEAST_RANGES.
RANGE_SCORES, LEAST_RANGES, MOST_RANGES = 100_000, 64, 10_000


def running_by_score(df: DataFrame, descending: bool, blocks: int | None = None) -> DataFrame:
    """Per distinct score, `hits` and `n` with their sums over all scores before it, in either order.

    The order is total, but no task gets all of it: scores are dealt into ranges, summed within, and the sums of the
    few ranges before are added. The ranges' edges are fixed first, as numbers, so that a task that runs again finds
    its rows in the same ranges. `df` is read once: the counts of its scores are written, as four jobs read them.
    """
    counted = settled(_by_score(df))
    if blocks is None:
        distinct = counted.agg(F.approx_count_distinct("p", 0.05)).first()[0]
        blocks = min(MOST_RANGES, max(LEAST_RANGES, distinct // RANGE_SCORES))
    edges = sorted(set(counted.approxQuantile("p", [i / blocks for i in range(1, blocks)], min(0.002, 0.25 / blocks))))
    if blocks > LEAST_RANGES:  # many edges are searched, not compared one by one
        block = F.when(F.col("p").isNotNull(), _edges_below(edges)(F.col("p")))
    else:
        block = F.size(F.filter(F.array(*map(F.lit, edges)).cast("array<double>"), lambda e: e < P()))
    block = -block if descending else block
    order = F.col("p").desc() if descending else F.col("p").asc()
    inside = Window.partitionBy("block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ranged = counted.withColumn("block", block)
    own = ranged.select("p", "hits", "n", "block", F.coalesce(F.sum("hits").over(inside), F.lit(0)).alias("h"), F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("c"))
    spans = ranged.groupBy("block").agg(F.sum("hits").alias("bh"), F.sum("n").alias("bn"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    spans = spans.select("block", F.coalesce(F.sum("bh").over(before), F.lit(0)).alias("ph"), F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("pn"))
    return own.join(F.broadcast(spans), "block").select("p", "hits", "n", (F.col("h") + F.col("ph")).alias("hits_before"), (F.col("c") + F.col("pn")).alias("n_before"))


def _edges_below(edges: Sequence[float]):
    """How many of the rising edges are below a value."""
    at = np.array(edges, float)

    @F.pandas_udf("int")
    def below(p: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at, p.to_numpy(float), side="left").astype("int32"))

    return below


def roc_auc(df: DataFrame) -> DataFrame:
    """The chance that a hit scores above a miss, ties counted half; null with one class only."""
    r = running_by_score(df, descending=False)
    misses_before = F.col("n_before") - F.col("hits_before")
    misses = F.col("n") - F.col("hits")
    won = F.sum(F.col("hits") * (misses_before + misses / 2))
    return r.agg(F.try_divide(won, F.sum("hits") * F.sum(misses)).alias("auc"))


def average_precision(df: DataFrame) -> DataFrame:
    """Sum of precision times recall gained at each distinct score, from the highest."""
    r = running_by_score(df, descending=True)
    precision = (F.col("hits_before") + F.col("hits")) / (F.col("n_before") + F.col("n"))
    return r.agg(F.try_divide(F.sum(F.col("hits") * precision), F.sum("hits")).alias("average_precision"))


def z_simple(df: DataFrame) -> DataFrame:
    return df.agg(F.try_divide(F.sum(Y() - P()), F.sqrt(F.sum(P() * (1 - P())))).alias("z"))


def spiegelhalter(df: DataFrame) -> DataFrame:
    w = 1 - 2 * P()
    return df.agg(F.try_divide(F.sum((Y() - P()) * w), F.sqrt(F.sum(w * w * P() * (1 - P())))).alias("z"))


def spearman(df: DataFrame, x: str, y: str, least: int = 100) -> DataFrame:
    """Rank correlation of rows where both are known; null under `least` of them.

    Ranks come from the counts of distinct values, so that the rows themselves are never put in one order.
    """
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))

    def ranks(c: str) -> DataFrame:
        r = running_by_score(known.select(F.col(c).alias("p"), F.lit(0).alias("y")), descending=False)
        return r.select(F.col("p").alias(c), (F.col("n_before") + (F.col("n") + 1) / 2).alias(f"{c}_rank"))

    joined = known.join(ranks("x"), "x").join(ranks("y"), "y")
    return joined.agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= least, F.corr("x_rank", "y_rank")).alias("spearman"))


def exact_quantiles(df: DataFrame, column: str, qs: Sequence[float]) -> list[float | None]:
    """Exact interpolated quantiles of the non-null values; nulls for an empty column.

    Cumulative counts of distinct values come from ranges, and only the values next to the wanted ranks reach the
    driver: no task holds all distinct values, as the built-in exact percentile would.
    """
    known = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("p"), F.lit(0).alias("y"))
    total = known.count()
    if not total:
        return [None for _ in qs]
    wanted = [q * (total - 1) for q in qs]
    ranks = sorted({int(w) for w in wanted} | {min(int(w) + 1, total - 1) for w in wanted})
    r = running_by_score(known, descending=False)
    holds = F.exists(F.array(*(F.lit(k).cast("long") for k in ranks)), lambda k: (F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n")))
    found = r.where(holds).select("p", "n", "n_before").collect()
    at = {k: next(x.p for x in found if x.n_before <= k < x.n_before + x.n) for k in ranks}
    return [at[int(w)] + (at[min(int(w) + 1, total - 1)] - at[int(w)]) * (w - int(w)) for w in wanted]


def quantile_edges(df: DataFrame, bins: int) -> list[float]:
    """The exact quantiles 0, 1/bins, .., 1 of p, duplicates dropped."""
    return sorted({e for e in exact_quantiles(df, "p", [i / bins for i in range(bins + 1)]) if e is not None})


def reliability(df: DataFrame, bins: int = 10) -> DataFrame:
    """Per right-closed quantile bin of p: rows, mean p, mean y."""
    inner = F.array(*map(F.lit, quantile_edges(df, bins)[1:-1])).cast("array<double>")
    bin_ = F.size(F.filter(inner, lambda e: e < P()))
    return df.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(P()).alias("mean_p"), F.avg(Y()).alias("mean_y"))


def expected_calibration_error(df: DataFrame, bins: int = 10) -> DataFrame:
    return reliability(df, bins).agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))) / F.sum("n")).alias("ece"))


def ks_uniform(df: DataFrame) -> DataFrame:
    """Largest distance between the distribution of p and the uniform one."""
    r = running_by_score(df.withColumn("y", F.lit(0)), descending=False)
    total = r.agg(F.sum("n").alias("total"))
    after = (F.col("n_before") + F.col("n")) / F.col("total") - P()
    before = P() - F.col("n_before") / F.col("total")
    return r.crossJoin(F.broadcast(total)).agg(F.max(F.greatest(after, before)).alias("ks"))


def segment_summary(rows: DataFrame, least: int = 10) -> DataFrame:
    """Scores over all rows, by proposition, by vendor and by line, in one pass; vendors and lines under `least` rows are left out."""
    positive = F.col("best_ev") > 0
    won = F.when(F.col("best_side") == "over", F.col("over_hit")).otherwise(F.col("under_hit"))
    return rows.groupingSets([[], ["prop_type"], ["vendor"], ["line_value"]], "prop_type", "vendor", "line_value").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.avg(O.log_loss(F.col("model_over_prob"), F.col("over_hit"))).alias("model_log_loss"),
        F.avg(O.log_loss(F.col("market_over_prob"), F.col("over_hit"))).alias("market_log_loss"), F.avg("best_ev").alias("mean_best_ev"),
        F.avg(positive.cast("int")).alias("share_positive_ev"), F.avg(F.abs(F.col("market_over_prob") - 0.5)).alias("mean_market_distance"),
        *(F.avg((F.col("best_ev") > limit).cast("int")).alias(f"share_ev_over_{name}") for name, limit in (("1pct", 0.01), ("2pct", 0.02))),
        F.count_if(positive).alias("n_positive_ev"), F.avg(F.when(positive, won)).alias("positive_ev_hit_rate"), F.avg(F.when(positive, F.col("best_ev"))).alias("positive_ev_mean_ev"),
    ).where((F.col("n") >= least) | F.col("level").isin(7, 3))


def kolmogorov_p(statistic: Column, n: Column) -> Column:
    """Asymptotic p-value of the two-sided test, 100 terms."""
    x = (F.sqrt(n) + 0.12 + 0.11 / F.sqrt(n)) * statistic
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2 * k * k * x * x))
    total = 2 * F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)
    return F.when(x > 0.2, F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))).otherwise(1.0)
