"""Queries of fitted chains: from events to calibrated distributions, and isotonic curves as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chain as CH
from ..operators import features as X
from ..operators import market as M
from ..operators import pooling as PO
from ..operators import selection as C
from ..operators import stakes as ST
from .catalogue import SCORED, evaluated, logits_pmf, r6, register, scored
from .views import pa_view, quote_view

SESSION = ("day", "pitcher_id")
FEATURES = ("bf_so_far", "pitch_count_pa_so_far", "pitches_per_bf", "times_through", "heavy_workload", *(f"pitcher_id_{m}_{n}" for m in ("is_strikeout", "is_hit", "is_out", "pitch_count_pa") for n in (15, 60)))


def session_events(spark, d):
    """Events with their features; a session is a pitcher's events of one day."""
    rated = X.rolling_rates(pa_view(spark, d), "pitcher_id", ("is_strikeout", "is_hit", "is_out", "pitch_count_pa"), (15, 60))
    return X.state_so_far(rated.withColumn("day", F.to_date("ts")), SESSION, ("ts", "event_id"))


def fitted_chain(spark, d, rounds: int | None = None, stop_rounds: int | None = None):
    """(model, starts of all parts)"""
    chain = CH.OutcomeChain(FEATURES, SESSION, rounds, stop_rounds)
    read = ("event_id", "is_strikeout", "pitch_count_pa_so_far", *FEATURES)
    return chain.fit_parts(CH.settled(session_events(spark, d).select(*SESSION, *dict.fromkeys(read))))


@register("fitted_chain_report")
def fitted_chain_report(spark, d):
    """Log score and ranked probability score of each stage on sessions of days that nothing was fitted on.

    Both classifiers have the chain's own rounds, 350 and 300.
    """
    model, starts = fitted_chain(spark, d)
    return r6(model.report(starts.where("part = 'evaluate'")))


def _iso_sql(by: str) -> str:
    """Isotonic values by the max-min formula over the distinct scores of each group."""
    return f"""c AS (SELECT {by}, p, sum(y) AS s, count(*) AS n, row_number() OVER (PARTITION BY {by} ORDER BY p) AS i FROM f GROUP BY {by}, p),
 m AS (SELECT a.{by}, a.i AS j, b.i AS k, sum(b.s) OVER w / sum(b.n) OVER w AS v FROM c a JOIN c b ON a.{by} = b.{by} AND b.i >= a.i WINDOW w AS (PARTITION BY a.{by}, a.i ORDER BY b.i)),
 l AS (SELECT {by}, j, k, min(v) OVER (PARTITION BY {by}, j ORDER BY k DESC) AS v FROM m),
 iso AS (SELECT c.{by}, c.p, c.i, max(l.v) AS v FROM c JOIN l ON l.{by} = c.{by} AND l.k = c.i AND l.j <= c.i GROUP BY ALL)"""


@register("isotonic_apply", f"""{SCORED}, f AS (SELECT 0 AS g, p, y FROM t), {_iso_sql('g')} SELECT p, round(least(greatest(v, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE), 6) AS q FROM iso""")
def isotonic_apply(spark, d):
    s = scored(spark, d).withColumn("g", F.lit(0))
    return r6(PO.apply_curves(s.select("g", "p").distinct(), PO.fit_curves(s, ["g"]), ["g"]).select("p", "q"))


@register("isotonic_groups", f"""{SCORED}, f AS (SELECT CAST(round(l_discount * 100) AS INTEGER) AS g, p, y FROM t WHERE CAST(round(p * 100) AS INTEGER) % 3 <> 0), {_iso_sql('g')},
 x AS (SELECT g, (k - 5) / 200.0E0 AS x FROM (SELECT DISTINCT g FROM f) a, range(220) b(k)),
 e AS (SELECT x.g, x.x, arg_max(iso.p, iso.p) FILTER (WHERE iso.p <= x.x) AS p0, arg_max(iso.v, iso.p) FILTER (WHERE iso.p <= x.x) AS v0, arg_min(iso.p, iso.p) FILTER (WHERE iso.p > x.x) AS p1, arg_min(iso.v, iso.p) FILTER (WHERE iso.p > x.x) AS v1 FROM x JOIN iso USING (g) GROUP BY ALL)
 SELECT g, x AS p, round(least(greatest(CASE WHEN p0 IS NULL THEN v1 WHEN p1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (x - p0) / (p1 - p0) END, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE), 6) AS q FROM e""")
def isotonic_groups(spark, d):
    """Eleven curves in one fit, read between and beyond their knots."""
    rows = scored(spark, d).select(F.round(F.col("l_discount") * 100).cast("int").alias("g"), "p", "y").where(F.round(F.col("p") * 100).cast("int") % 3 != 0)
    asked = rows.select("g").distinct().select("g", F.explode(F.sequence(F.lit(0), F.lit(219))).alias("k")).select("g", ((F.col("k") - 5) / 200.0).alias("p"))
    return r6(PO.apply_curves(asked, PO.fit_curves(rows, ["g"]), ["g"]))


@register("count_curve_fit")
def count_curve_fit(spark, d):
    """Distributions of `embeddings` calibrated by the curves of all their counts, fitted at once."""
    rows = logits_pmf(spark, d).select("vec_id", "pmf", (F.col("vec_id") % 12).alias("actual"))
    cells = PO.apply_count_curves(rows, PO.fit_count_curves(rows, 12), ["vec_id"])
    return r6(cells.select("vec_id", F.posexplode("pmf").alias("k", "p")))


@register("board_stakes")
def board_stakes(spark, d):
    """The best bets of all games, sized as one board under its cap."""
    best = C.card(evaluated(spark, d), C.quote_summary(M.evaluation_quotes(quote_view(spark, d))), 1.0, 2, 0.10, None, ties=["vendor", *M.TIES])
    over = F.col("best_side") == "over"
    sided = best.withColumns({"prob": F.when(over, F.col("model_over_prob")).otherwise(1 - F.col("model_over_prob")), "odds": F.when(over, F.col("over_odds")).otherwise(F.col("under_odds"))})
    rows = C.kelly_columns(sided, "prob", "odds").withColumns({"uncertainty": F.lit(0.03), "board": F.lit("all")})
    keys = ("game_id", "player_id", "vendor", "line_value", "best_side")
    sized = ST.size_board_stakes(rows.select("board", *keys, "prob", "decimal_odds", "ev", "stake_kelly", "uncertainty"), "board")
    return r6(sized.select(*keys, "weight", "stake"))
