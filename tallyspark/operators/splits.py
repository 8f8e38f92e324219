"""Splits by time, and the calibration error over right-closed bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import P, Y, exact_quantiles
from .ranges import last_rows


def out_of_time(df: DataFrame, day: Column, calibrate: float = 0.10, evaluate: float = 0.10, least: int = 7, least_days: int = 30) -> DataFrame:
    """Adds part: train, calibrate or evaluate by the last shares of the distinct days; rows without a day are left out.

    Fewer than `least_days` days are an error. The days that are ranked are one row each.
    """
    dated = df.withColumn("_day", day).where(F.col("_day").isNotNull())
    days = dated.select("_day").distinct()
    n = days.count()
    if n < least_days:
        raise ValueError(f"{n} days, at least {least_days} are needed")
    last, before = (max(least, round(n * share)) for share in (evaluate, calibrate))
    place = F.row_number().over(Window.orderBy("_day"))
    part = F.when(place > n - last, "evaluate").when(place > n - last - before, "calibrate").otherwise("train")
    return dated.join(days.select("_day", part.alias("part")), "_day").drop("_day")


def tail_split(df: DataFrame, order: list[str], least: int = 200, share: int = 5) -> DataFrame:
    """Adds is_train: false for the last max(least, rows // share) rows in order (nulls first); for tables of a single day."""
    n = df.count()
    return last_rows(df, order, min(n, max(least, n // share)), "_held").select(*df.columns, (~F.col("_held")).alias("is_train"))


def digitised_error(df: DataFrame, bins: int = 15) -> DataFrame:
    """ECE of (p, y) over right-closed bins whose edges are the distinct quantiles of the clipped p; equal widths if fewer
    than four of them differ."""
    clipped = df.withColumn("p", F.greatest(F.least(P(), F.lit(1 - 1e-6)), F.lit(1e-6)))
    edges = sorted({e for e in exact_quantiles(clipped, "p", [i / bins for i in range(bins + 1)]) if e is not None})
    if len(edges) < 4:
        edges = [i / bins for i in range(bins + 1)]
    inner = F.array(*map(F.lit, edges[1:-1])).cast("array<double>")
    grouped = clipped.groupBy(F.size(F.filter(inner, lambda e: e < P())).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(P()).alias("mean_p"), F.avg(Y()).alias("mean_y"))
    return grouped.agg((F.sum(F.col("n") * F.abs(F.col("mean_y") - F.col("mean_p"))) / F.sum("n")).alias("ece"))
