"""Distributions of a count as arrays of doubles, index = count, in higher-order functions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .odds import clip

FLOOR = 1e-12
#: ln(k!) with the last bits of C's lgamma, which SQL engines call; Python's own lgamma and ln(k!) round some of them otherwise.
LN_FACTORIALS = (
    0.0, 0.0, 0.6931471805599453, 1.791759469228055, 3.1780538303479458, 4.787491742782046, 6.579251212010101, 8.525161361065413,
    10.60460290274525, 12.80182748008147, 15.104412573075518, 17.502307845873887, 19.98721449566189, 22.55216385312342, 25.19122118273868, 27.89927138384089,
    30.671860106080675, 33.50507345013689, 36.39544520803305, 39.339884187199495, 42.335616460753485, 45.380138898476915, 48.47118135183523, 51.60667556776438,
    54.78472939811231, 58.003605222980525, 61.261701761002, 64.55753862700632, 67.88974313718154, 71.25703896716801, 74.65823634883017, 78.0922235533153,
    81.55795945611503, 85.05446701758153, 88.58082754219767, 92.1361756036871, 95.7196945421432,
)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once; inside lambdas an expression is otherwise computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def normalise(a: Column) -> Column:
    """Divided by its sum; null if that is zero."""
    return let(a, lambda v: let(total(v), lambda s: F.when(s > 0, F.transform(v, lambda x: x / s))))


def cdf(a: Column) -> Column:
    """Running sums."""
    return F.aggregate(a, F.array().cast("array<double>"), lambda s, x: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0.0)) + x)))


def mean(a: Column) -> Column:
    return total(F.transform(a, lambda x, i: x * i))


def quantile(a: Column, q: float) -> Column:
    """The smallest count whose cumulative probability reaches q."""
    return F.least(F.size(F.filter(cdf(a), lambda x: x < q - FLOOR)), F.size(a) - 1)


def over(a: Column, line: Column) -> Column:
    return total(F.filter(a, lambda x, i: i > line))


def under(a: Column, line: Column) -> Column:
    return total(F.filter(a, lambda x, i: i < line))


def push(a: Column, line: Column) -> Column:
    return total(F.filter(a, lambda x, i: i == line))


def poisson_binomial(p: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """The count of successes of independent trials with probabilities p (clipped)."""
    zero = F.array(F.lit(0.0))
    step = lambda s, x: F.zip_with(F.concat(s, zero), F.concat(zero, s), lambda stay, up: stay * (1 - clip(x, low, high)) + up * clip(x, low, high))
    return F.aggregate(p, F.array(F.lit(1.0)), step)


def _ln_factorial(k: int) -> float:
    return LN_FACTORIALS[k] if k < len(LN_FACTORIALS) else math.lgamma(k + 1)


def _binomial(p: float, n: int) -> list[float]:
    up, stay = math.log(p), math.log(1 - p)
    return [math.exp(_ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k) + k * up + (n - k) * stay) for k in range(n + 1)]


@F.pandas_udf(ArrayType(DoubleType()))
def binomial(p: pd.Series, n: pd.Series) -> pd.Series:
    """The count of successes of n independent trials with the same probability p, 0 < p < 1, by its closed form.

    Logarithms and exponentials are C's, term by term as in SQL: where the chance of one side is below 1e-6 the last bit of
    the other's shows in a fair price, and Spark's own functions round it otherwise.
    """
    return pd.Series([_binomial(q, int(m)) for q, m in zip(p, n, strict=True)], dtype=object)


def fold_tail(a: Column, size: int) -> Column:
    """Exactly `size` cells: padded with zeros, or cut with what is beyond added to the last, in the order of the cells."""
    head = F.slice(F.concat(a, F.array_repeat(F.lit(0.0), size)), 1, size - 1)
    return F.concat(head, F.array(total(F.filter(a, lambda x, i: i >= size - 1))))


def temperature(a: Column, t: Column) -> Column:
    return normalise(F.transform(a, lambda x: F.pow(F.greatest(x, F.lit(FLOOR)), 1.0 / t)))


def tilt(a: Column, tau: Column, lam: Column) -> Column:
    """softmax(log p / tau + lam * count)."""
    raised = F.transform(a, lambda x, i: F.log(F.greatest(x, F.lit(FLOOR))) / tau + lam * i)
    return let(raised, lambda r: let(F.array_max(r), lambda top: normalise(F.transform(r, lambda x: F.exp(x - top)))))


def logs(a: Column) -> Column:
    return F.transform(a, lambda x: F.log(F.greatest(x, F.lit(FLOOR))))


def tilted_over(log_a: Column, tau: Column, lam: Column, line: Column) -> Column:
    """over(tilt(a, tau, lam), line) from logs(a), which a grid of cells shares; each cell takes one exponential a count."""
    raised = F.transform(log_a, lambda x, i: F.exp(x / tau + lam * i))
    return let(raised, lambda r: total(F.filter(r, lambda x, i: i > line)) / total(r))


def ranked_probability_score(a: Column, actual: Column) -> Column:
    """Mean squared distance of the CDF from the step at the actual count."""
    steps = F.transform(cdf(a), lambda x, i: F.pow(x - F.when(i >= actual, 1.0).otherwise(0.0), 2.0))
    return total(steps) / F.size(a)


def calibrated_from_cdf(c: Column) -> Column:
    """A PMF from a CDF that need not be monotone: clip, running maximum, last = 1, differences, normalised."""
    clipped = F.transform(c, lambda x, i: F.when(i == F.size(c) - 1, F.lit(1.0)).otherwise(clip(x, 1e-6, 1 - 1e-6)))
    rising = F.aggregate(clipped, F.array().cast("array<double>"), lambda s, x: F.concat(s, F.array(F.greatest(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0.0)), x))))
    return normalise(let(rising, lambda r: F.transform(r, lambda x, i: F.greatest(x - F.when(i > 0, F.try_element_at(r, i)).otherwise(0.0), F.lit(0.0)))))


def lengths(hazards: Column) -> Column:
    """The distribution of the length 0..n of a session from the chances to end at step 1..n; who is left at the end has n."""
    empty = F.struct(F.lit(1.0).alias("alive"), F.array(F.lit(0.0)).alias("ends"))
    step = lambda s, h: F.struct((s["alive"] * (1 - h)).alias("alive"), F.concat(s["ends"], F.array(s["alive"] * h)).alias("ends"))
    at_end = lambda s: F.transform(s["ends"], lambda x, i: F.when(i == F.size(s["ends"]) - 1, x + s["alive"]).otherwise(x))
    return F.aggregate(hazards, empty, step, at_end)


def mixture(steps: Column, length: Column, size: int) -> Column:
    """The count of successes of the first n steps with these chances, over the distribution of n; the last cell keeps
    what passes it. One fold: the running distribution grows by a step and is added with the weight of its length."""
    first = F.array(F.lit(1.0), *(F.lit(0.0) for _ in range(size - 1)))

    def grown(run: Column, p: Column) -> Column:
        moved = lambda x, i: x * (1 - p) + F.when(i > 0, F.try_element_at(run, i) * p).otherwise(0.0) + F.when(i == size - 1, x * p).otherwise(0.0)
        return F.transform(run, moved)

    def step(s: Column, x: Column) -> Column:
        return let(grown(s["run"], clip(x["p"], 0.0, 1.0)), lambda run: F.struct(run.alias("run"), F.zip_with(s["out"], run, lambda o, r: o + r * x["w"]).alias("out")))

    pairs = F.zip_with(steps, F.slice(length, 2, F.size(steps)), lambda p, w: F.struct(p.alias("p"), w.alias("w")))
    start = F.struct(first.alias("run"), F.transform(first, lambda x: x * F.element_at(length, 1)).alias("out"))
    return normalise(F.aggregate(pairs, start, step, lambda s: s["out"]))
