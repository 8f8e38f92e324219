"""Isotonic curves of many groups at once: fitted by parallel pooling, kept as tables, applied by an interval join.

Pooling adjacent violators is associative over ordered lists of blocks: lists may be pooled on their own first and again
once they are put together. So ranges of scores are pooled where they lie, and what a group sends on is its blocks, not
its rows. For outcomes of 0 and 1 blocks are fractions that rise strictly, so n rows leave fewer than 2 n^(2/3) of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import odds as O
from ..functions import pmf as PMF

LEAST_DISTINCT = 5
BINS = 256
_BLOCK = ("low", "high", "sum_y", "n", "scores")


def pool(blocks: np.ndarray) -> np.ndarray:
    """Rows (low, high, sum_y, n, scores) in rising order of the score, put together until their means rise."""
    kept: list[list[float]] = []
    for low, high, total, n, scores in blocks.tolist():
        while kept and kept[-1][2] * n >= total * kept[-1][3]:
            before = kept.pop()
            low, total, n, scores = before[0], before[2] + total, before[3] + n, before[4] + scores
        kept.append([low, high, total, n, scores])
    return np.array(kept).reshape(-1, len(_BLOCK))


def _pooled(frame: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """The blocks of each group of a frame sorted by keys and score."""
    group = (frame[keys] != frame[keys].shift()).any(axis=1).cumsum()
    parts = []
    for _, own in frame.groupby(group, sort=False):
        blocks = pd.DataFrame(pool(own[list(_BLOCK)].to_numpy(float)), columns=list(_BLOCK))
        for k in keys:
            blocks[k] = own[k].iloc[0]
        parts.append(blocks)
    return pd.concat(parts)[[*keys, *_BLOCK]]


def _in_ranges(keys: list[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame])
            if len(held):
                held = _pooled(held, keys)
                last = (held[keys] == held[keys].iloc[-1]).all(axis=1)
                yield held[~last]
                held = held[last]
        if held is not None and len(held):
            yield held

    return run


def _segments(keys: list[str]):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        blocks = pool(frame[list(_BLOCK)].sort_values("low").to_numpy(float))
        if blocks[:, 4].sum() < LEAST_DISTINCT:
            blocks = blocks[:0]
        value = blocks[:, 2] / blocks[:, 3]
        one = blocks[:, 0] == blocks[:, 1]
        knots = np.stack([np.repeat(blocks[:, :2], 1, axis=0).ravel(), np.repeat(value, 2)], axis=1)
        knots = knots[np.stack([np.ones(one.size, bool), ~one], axis=1).ravel()]
        low, high = np.r_[-np.inf, knots[:, 0]][: len(knots) + bool(len(knots))], np.r_[knots[:, 0], np.inf][: len(knots) + bool(len(knots))]
        at_low, at_high = np.r_[knots[:1, 1], knots[:, 1]], np.r_[knots[:, 1], knots[-1:, 1]]
        return pd.DataFrame({**{k: frame[k].iloc[0] for k in keys}, "low": low, "high": high, "at_low": at_low, "at_high": at_high})

    return run


def fit_curves(df: DataFrame, keys: Sequence[str], p: str = "p", y: str = "y") -> DataFrame:
    """(keys, low, high, at_low, at_high): the segments of each group's rising curve from score p to the chance of y.

    A segment holds low <= p < high; between its ends the curve is a line, outside the outermost scores it is flat.
    Groups of fewer than LEAST_DISTINCT scores have none, as have null keys, scores and outcomes. Rows are aggregated to
    counts of distinct scores, dealt into ranges of group and score, and pooled there; a group then meets its blocks.
    """
    keys = list(keys)
    known = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).dropna(subset=keys)
    counted = known.groupBy(*keys, F.col(p).cast("double").alias("low")).agg(F.sum(F.col(y).cast("double")).alias("sum_y"), F.count(F.lit(1)).cast("double").alias("n"))
    dealt = counted.select(*keys, "low", F.col("low").alias("high"), "sum_y", "n", F.lit(1.0).alias("scores")).repartitionByRange(*keys, "low").sortWithinPartitions(*keys, "low")
    fields = [dealt.schema[k] for k in keys]
    doubles = lambda names: T.StructType([*fields, *(T.StructField(n, T.DoubleType()) for n in names)])
    blocks = dealt.mapInPandas(_in_ranges(keys), doubles(_BLOCK))
    return blocks.groupBy(*keys).applyInPandas(_segments(keys), doubles(("low", "high", "at_low", "at_high")))


def _bin(x: Column) -> Column:
    return F.floor(O.clip(x, 0.0, 1.0) * BINS).cast("int")


def apply_curves(df: DataFrame, curves: DataFrame, keys: Sequence[str], p: str = "p", out: str = "q") -> DataFrame:
    """Adds `out`: p on its group's curve, clipped; p itself where the group has none, null where p is.

    Scores meet segments by an equi-join on the group and one of BINS equal bins of [0, 1], so a score is held against
    the few segments of its bin and no knot is written into the plan.
    """
    keys = list(keys)
    own = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    spread = F.explode(F.sequence(_bin(F.col("low")), _bin(F.col("high")))).alias("_bin")
    table = curves.select(*own, spread, F.col("low").alias("_low"), F.col("high").alias("_high"), F.col("at_low").alias("_at_low"), F.col("at_high").alias("_at_high"))
    score = F.col(p).cast("double")
    met = (_bin(score) == F.col("_bin")) & (score >= F.col("_low")) & (score < F.col("_high"))
    for i, k in enumerate(keys):
        met = met & (df[k] == F.col(f"_k{i}"))
    line = F.col("_at_low") + (F.col("_at_high") - F.col("_at_low")) * (score - F.col("_low")) / (F.col("_high") - F.col("_low"))
    flat = F.col("_at_low") == F.col("_at_high")
    value = F.when(F.col("_low").isNull(), score).when(flat, F.col("_at_low")).otherwise(line)
    return df.join(table, met, "left").select(*(df[c] for c in df.columns if c != out), O.clip_probability(value).alias(out))


def fit_count_curves(df: DataFrame, size: int, pmf: str = "pmf", actual: str = "actual") -> DataFrame:
    """The curves of all counts k below the last, in one fit: from the raw CDF at k to the chance that the actual is at most k."""
    long = df.where(F.col(actual).isNotNull()).select(F.posexplode(PMF.cdf(F.col(pmf))).alias("k", "c"), actual)
    return fit_curves(long.select("k", O.clip_probability(F.col("c")).alias("p"), (F.col(actual) <= F.col("k")).cast("int").alias("y")).where(F.col("k") < size - 1), ["k"])


def apply_count_curves(df: DataFrame, curves: DataFrame, keys: Sequence[str], pmf: str = "pmf") -> DataFrame:
    """`df`, whose rows the keys name, with its pmf calibrated by the curves of its counts."""
    keys, others = list(keys), [c for c in df.columns if c not in (*keys, pmf)]
    packed = df.select(*keys, F.struct(F.lit(0).alias("_"), *others).alias("_row"), F.col(pmf).alias("_pmf"))
    long = packed.select(*keys, "_row", F.posexplode(PMF.cdf(F.col("_pmf"))).alias("k", "_c"))
    cells = apply_curves(long.withColumn("p", F.col("_c")), curves, ["k"])
    # A distribution has as many cells as it has counts.
    gathered = cells.groupBy(*keys).agg(F.first("_row").alias("_row"), F.transform(F.array_sort(F.collect_list(F.struct("k", "q"))), lambda x: x["q"]).alias("_cdf"))
    return gathered.select(*(F.col(c) if c in keys else PMF.calibrated_from_cdf(F.col("_cdf")).alias(pmf) if c == pmf else F.col(f"_row.{c}") for c in df.columns))
