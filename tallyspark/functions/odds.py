"""Prices as Column expressions. American odds of magnitude below 100, zero included, are invalid and give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-6


def clip(x: Column, low: float, high: float) -> Column:
    """Null stays null."""
    return F.when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)


def clip_probability(p: Column, epsilon: float = EPSILON) -> Column:
    return clip(p, epsilon, 1 - epsilon)


def clean(x: Column) -> Column:
    """Null for NaN and the infinities."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def valid_odds(odds: Column) -> Column:
    return F.when(F.abs(odds) >= 100, odds.cast("double"))


def implied_probability(odds: Column) -> Column:
    o = valid_odds(odds)
    return F.when(o > 0, 100.0 / (o + 100.0)).otherwise(-o / (100.0 - o))


def profit(odds: Column) -> Column:
    """Gain on a stake of one."""
    o = valid_odds(odds)
    return F.when(o > 0, o / 100.0).otherwise(-100.0 / o)


def no_vig(over: Column, under: Column) -> Column:
    """The over side's share of the two implied probabilities; null unless both sides are quoted."""
    a, b = implied_probability(over), implied_probability(under)
    return a / (a + b)


def expected_value(p: Column, odds: Column) -> Column:
    q = clip_probability(p)
    return q * profit(odds) - (1 - q)


def kelly(p: Column, odds: Column) -> Column:
    gain = profit(odds)
    return F.when(gain.isNotNull() & p.isNotNull(), F.greatest((gain * p - (1 - p)) / gain, F.lit(0.0)))


def fair_odds(p: Column) -> Column:
    q = clip_probability(p)
    return F.when(q >= 0.5, -100 * q / (1 - q)).otherwise(100 * (1 - q) / q)


def fair_odds_integer(p: Column) -> Column:
    """Rounded half to even, as the price a board shows."""
    q = clip_probability(p, 1e-9)
    return F.when(q >= 0.5, F.bround(-100 * q / (1 - q))).otherwise(F.bround(100 * (1 - q) / q)).cast("long")


def is_half_point(line: Column) -> Column:
    return F.abs(F.pmod(line, F.lit(1.0)) - 0.5) <= 5.01e-6


def log_loss(p: Column, y: Column) -> Column:
    q = clip_probability(p)
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def brier(p: Column, y: Column) -> Column:
    return (clip_probability(p) - y) * (clip_probability(p) - y)
