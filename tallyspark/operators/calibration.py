"""Calibrators: fitted in Spark, kept as small tables of parameters, applied as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import odds as O
from ..functions import pmf as PMF
from .lineage import settled

LEAST_DISTINCT = 5


def logit(p: Column) -> Column:
    q = O.clip_probability(p)
    return F.log(q / (1 - q))


@dataclass
class Isotonic:
    """A rising step curve; between knots it is interpolated, outside them it is flat."""

    knots: list[float]
    values: list[float]

    def apply(self, p: Column) -> Column:
        if not self.knots:
            return O.clip_probability(p)
        curve = F.array(*(F.struct(F.lit(float(k)).alias("k"), F.lit(float(v)).alias("v")) for k, v in zip(self.knots, self.values, strict=True)))

        def between(c: Column) -> Column:
            at = F.size(F.filter(c, lambda s: s["k"] <= p))
            low, high = F.try_element_at(c, F.greatest(at, F.lit(1))), F.try_element_at(c, F.least(at + 1, F.size(c)))
            span = high["k"] - low["k"]
            return F.when((at == 0) | (span <= 0), low["v"]).otherwise(low["v"] + (high["v"] - low["v"]) * (p - low["k"]) / span)

        return O.clip_probability(PMF.let(curve, between))


def outcome_counts(df: DataFrame, *others: str, p: str = "p", y: str = "y") -> DataFrame:
    """(p, y, others, weight): how often each score comes with each outcome. Fits and means need no more than that, so
    rows that have a weight, as those of such a table, count so often."""
    times = F.sum("weight") if "weight" in df.columns else F.count(F.lit(1))
    known = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    return known.groupBy(F.col(p).cast("double").alias("p"), F.col(y).cast("double").alias("y"), *others).agg(times.cast("double").alias("weight"))


def fit_isotonic(df: DataFrame, p: str = "p", y: str = "y") -> Isotonic:
    """From counts of distinct scores; the identity with fewer than LEAST_DISTINCT of them."""
    return _isotonic_of(outcome_counts(df, p=p, y=y))


def _isotonic_of(counts: DataFrame) -> Isotonic:
    return _fit_counted(counts.groupBy(F.col("p").alias("features")).agg((F.sum(F.col("y") * F.col("weight")) / F.sum("weight")).alias("label"), F.sum("weight").alias("weight")))


def _fit_counted(counted: DataFrame) -> Isotonic:
    if counted.limit(LEAST_DISTINCT).count() < LEAST_DISTINCT:
        return Isotonic([], [])
    model = IsotonicRegression(weightCol="weight").fit(counted)
    return Isotonic(list(model.boundaries), list(model.predictions))


@dataclass
class Logistic:
    """sigmoid(intercept + sum of weights times transformed p): Platt on the logit, beta on ln p and -ln(1 - p)."""

    weights: list[float]
    intercept: float
    kind: str

    def apply(self, p: Column) -> Column:
        x = sum((w * f for w, f in zip(self.weights, _inputs(p, self.kind), strict=True)), F.lit(self.intercept))
        return O.clip_probability(1 / (1 + F.exp(-x)))


def _inputs(p: Column, kind: str) -> list[Column]:
    q = O.clip_probability(p)
    return [logit(p)] if kind == "platt" else [F.log(q), F.log(1 - q)]


def fit_logistic(df: DataFrame, kind: str = "platt", c: float = 1.0, p: str = "p", y: str = "y") -> Logistic:
    return _logistic_of(outcome_counts(df, p=p, y=y), kind, c)


def _logistic_of(counts: DataFrame, kind: str, c: float) -> Logistic:
    names = [f"x{i}" for i in range(1 if kind == "platt" else 2)]
    rows = counts.select(*(e.alias(n) for e, n in zip(_inputs(F.col("p"), kind), names, strict=True)), F.col("y").alias("label"), "weight")
    n = rows.agg(F.sum("weight")).first()[0] or 1.0
    model = LogisticRegression(regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9, weightCol="weight").fit(VectorAssembler(inputCols=names, outputCol="features").transform(rows))
    return Logistic(list(model.coefficients), float(model.intercept), kind)


def candidates(df: DataFrame) -> dict[str, Column]:
    """The calibrators that a sweep compares, as expressions of p, fitted on df."""
    counts = settled(outcome_counts(df))
    out = {"identity": O.clip_probability(F.col("p")), "isotonic": _isotonic_of(counts).apply(F.col("p"))}
    for kind in ("platt", "beta"):
        for c in (0.1, 1.0, 10.0):
            out[f"{kind}_{c:g}"] = _logistic_of(counts, kind, c).apply(F.col("p"))
    return out


def sweep(train: DataFrame, test: DataFrame, tolerance: float = 1e-4) -> tuple[str, list[dict]]:
    """(winner, metrics): candidates are compared in order; a later one wins by log loss beyond the tolerance, else by Brier.

    The comparison is not transitive, so it folds over the few results in candidate order. Test rows are counted by score and
    outcome before they meet the candidates.
    """
    named = candidates(train)
    scored = outcome_counts(test).select("y", "weight", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), e.alias("q")) for n, e in named.items()))).alias("s")).select("y", "weight", "s.*")
    mean = lambda loss: F.sum(loss(F.col("q"), F.col("y")) * F.col("weight")) / F.sum("weight")
    found = {r["name"]: r.asDict() for r in scored.groupBy("name").agg(mean(O.log_loss).alias("log_loss"), mean(O.brier).alias("brier")).collect()}
    rows = [found[n] for n in named if n in found]
    best = rows[0]
    for r in rows[1:]:
        gain = best["log_loss"] - r["log_loss"]
        if gain > tolerance or (abs(gain) <= tolerance and best["brier"] - r["brier"] > tolerance):
            best = r
    return best["name"], rows


RESIDUAL_METRICS = ("log_loss", "market_log_loss", "delta_log_loss", "brier", "market_brier", "delta_brier", "mean_p", "mean_market")


def residual_sweep(train: DataFrame, test: DataFrame, market: str = "market_over_prob", tolerance: float = 1e-4) -> tuple[bool, str, list[dict]]:
    """(accepted, chosen, metrics) of calibrators of the prices in use: `current` leaves them as they are.

    Candidates are fitted on `train` (p, y) and scored on `test` (p, y, market) in one pass, current and identity first,
    then isotonic, then Platt and beta for each strength. One that beats those before it by log loss beyond the
    tolerance, or ties and beats them by Brier, is chosen; it is accepted if it beats `current` likewise.
    """
    fitted = candidates(train)
    order = ["identity", "isotonic", *(f"{kind}_{c:g}" for c in (0.1, 1.0, 10.0) for kind in ("platt", "beta"))]
    named = {"current": O.clip_probability(F.col("p")), **{n: fitted[n] for n in order}}
    y, m = F.col("y"), O.clip_probability(F.col(market))
    usable = test.where(F.col("p").isNotNull() & y.isNotNull() & F.col(market).isNotNull())
    usable = outcome_counts(usable, market)
    scored = usable.select("y", m.alias("m"), "weight", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), e.alias("q")) for n, e in named.items()))).alias("s")).select("y", "m", "weight", "s.*")
    q, m = F.col("q"), F.col("m")
    losses = {"log_loss": O.log_loss(q, y), "market_log_loss": O.log_loss(m, y), "brier": O.brier(q, y), "market_brier": O.brier(m, y), "mean_p": q, "mean_market": m}
    means = scored.groupBy("name").agg(*((F.sum(e * F.col("weight")) / F.sum("weight")).alias(c) for c, e in losses.items()))
    found = {r["name"]: r.asDict() for r in means.withColumns({"delta_log_loss": F.col("market_log_loss") - F.col("log_loss"), "delta_brier": F.col("market_brier") - F.col("brier")}).collect()}

    def beats(a: dict, b: dict) -> bool:
        gain = b["log_loss"] - a["log_loss"]
        return gain > tolerance or (abs(gain) <= tolerance and b["brier"] - a["brier"] > tolerance)

    rows = [found[n] for n in named if n in found]
    if not rows:
        return False, "current", []
    best = rows[0]
    for r in rows[1:]:
        if beats(r, best):
            best = r
    return best["name"] != "current" and beats(best, rows[0]), best["name"], sorted(rows, key=lambda r: (r["log_loss"], r["brier"], -r["delta_log_loss"]))


def fit_count_cdf(df: DataFrame, size: int, pmf: str = "pmf", actual: str = "actual") -> list[Isotonic]:
    """One isotonic curve for each count below the last: raw CDF to the chance that the actual is at most it.

    The rows are read once, into counts of distinct values for each count; the curves are fitted from these.
    """
    long = df.where(F.col(actual).isNotNull()).select(F.posexplode(PMF.cdf(F.col(pmf))).alias("k", "features"), actual).where((F.col("k") < size - 1) & F.col("features").isNotNull())
    counts = settled(long.groupBy("k", "features").agg(F.avg((F.col(actual) <= F.col("k")).cast("double")).alias("label"), F.count(F.lit(1)).cast("double").alias("weight")))
    return [_fit_counted(counts.where(F.col("k") == k).drop("k")) for k in range(size - 1)]


def apply_count_cdf(pmf: Column, curves: list[Isotonic]) -> Column:
    c = PMF.cdf(pmf)
    calibrated = F.array(*(curve.apply(F.element_at(c, k + 1)) for k, curve in enumerate(curves)), F.lit(1.0))
    return PMF.calibrated_from_cdf(calibrated)
