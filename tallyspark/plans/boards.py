"""The board of a quote universe: every open quote priced by the player's last state before a day, in four tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import odds as O
from ..functions import pmf as PMF
from ..operators import calibration as CAL
from ..operators import diagnostics as D
from ..operators import features as X
from ..operators import frames as FR
from ..operators import market as M
from ..operators import pooling as PO
from ..operators import selection as C
from ..operators.lineage import settled
from . import board as B
from .catalogue import EVALUATED, ORACLE_SQL, TWO_SIDED, _ev, evaluated, r6, register
from .views import PA_SQL, pa_view, quote_view, table

ENTRY = ("game_id", "player_name")


@dataclass
class Board:
    summary: DataFrame
    bets: DataFrame
    lines: DataFrame
    exact: DataFrame


def open_quotes(quotes: DataFrame, on: Column, prop_type: str) -> DataFrame:
    """Two-sided pregame quotes of named players on the board's days, the latest of each vendor and line."""
    kept = M.two_sided(M.pregame(quotes)).where(on & (F.col("prop_type") == prop_type) & F.col("player_name").isNotNull() & F.col("line_value").isNotNull())
    return M.latest_quotes(kept, [*ENTRY, "vendor", "line_value"])


def resolved(quotes: DataFrame, states: DataFrame) -> DataFrame:
    """(game_id, player_name, pmf) of the entries with a state, by their smallest id or else by their name."""
    entries = quotes.groupBy(*ENTRY).agg(F.min("player_id").alias("player_id"))
    found = FR.state_by_id_or_name(entries, states, "player_id", "player_name", ["pmf"])
    return found.where(F.col("pmf").isNotNull()).select(*ENTRY, "pmf")


def with_over(rows: DataFrame, out: str, threshold: CAL.Isotonic | DataFrame | None = None) -> DataFrame:
    """Adds `out`, the calibrated chance of over, to rows with a pmf and a line_value.

    `threshold` is a small calibrator, which goes into the plan, or a fitted curve as a table of one group `_curve`, which
    the rows meet in a join.
    """
    raw = O.clip_probability(PMF.over(F.col("pmf"), F.col("line_value")))
    if isinstance(threshold, DataFrame):
        return PO.apply_curves(rows.withColumns({"_raw": raw, "_curve": F.lit(0)}), threshold, ["_curve"], "_raw", out).drop("_raw", "_curve")
    return rows.withColumn(out, raw if threshold is None else threshold.apply(raw))


def priced_board(quotes: DataFrame, entries: DataFrame, threshold: CAL.Isotonic | DataFrame | None = None) -> Board:
    """The tables of a board from open quotes and entries (game_id, player_name, pmf).

    `threshold` is the calibrator of over prices. An entry without quotes has a summary and its exact counts only; quotes
    without an entry are left out.
    """
    priced = M.candidates(with_over(quotes.drop("model_over_prob").join(entries, list(ENTRY)), "model_over_prob", threshold).drop("pmf"))
    passes = C.strict_gate()
    bets = priced.withColumns({"passes_strict_ev_gate": passes, "action_tier": F.when(passes, "BET").otherwise("PASS")})

    near = F.struct(F.abs(F.col("market_over_prob") - 0.5), "snapshot_ts", "line_value", "vendor")
    main = quotes.groupBy(*ENTRY).agg(F.count(F.lit(1)).alias("top_quote_count"), F.countDistinct("vendor").alias("vendor_count"), F.min_by("line_value", near).alias("market_mean"))
    moments = {"k_mean": PMF.mean(F.col("pmf")), **{name: PMF.quantile(F.col("pmf"), q) for name, q in (("k_median", 0.5), ("k_p80", 0.8), ("k_p90", 0.9))}}
    summary = main.join(entries.withColumns(moments), list(ENTRY), "right").withColumn("market_mean_shift", F.col("market_mean") - F.col("k_mean")).drop("pmf")
    summary = summary.fillna(0, ["top_quote_count", "vendor_count"])

    grid = quotes.select(*ENTRY, "line_value").distinct().join(entries, list(ENTRY))
    grid = with_over(grid, "p_over", threshold).drop("pmf")
    lines = grid.withColumns({"p_under": 1 - F.col("p_over"), "p_push": F.lit(0.0), "fair_over": O.fair_odds(F.col("p_over")), "fair_under": O.fair_odds(1 - F.col("p_over"))})
    exact = entries.select(*ENTRY, F.posexplode("pmf").alias("strikeouts", "probability")).withColumn("fair", O.fair_odds(F.col("probability")))
    return Board(summary, bets, lines, exact)


def universe_board(quotes: DataFrame, states: DataFrame, tilt: tuple[float, float] | None = None, threshold: CAL.Isotonic | DataFrame | None = None) -> Board:
    """The tables of a board from open quotes (open_quotes) and states (player_id, player_name, pmf).

    `tilt` is the fitted (tau, lambda) of the distributions, `threshold` the calibrator of over prices. Distributions are
    tilted once a state, before they meet the quotes. Entries without a state are left out.
    """
    if tilt is not None:
        states = states.withColumn("pmf", PMF.tilt(F.col("pmf"), F.lit(tilt[0]), F.lit(tilt[1])))
    return priced_board(quotes, resolved(quotes, states), threshold)


def with_names(df: DataFrame, player: str) -> DataFrame:
    return df.withColumn("player_name", F.concat(F.lit("p"), F.col(player).cast("string")))


#: The year from which quotes are open. Where curves are fitted, quotes are open from a later one and the history is before.
OPEN_FROM, FITTED_FROM = 1994, 2000
TILT = (1.1, 0.02)
THRESHOLD = CAL.Isotonic([0.1, 0.5, 0.9], [0.15, 0.48, 0.85])


def fit_board_curves(rows: DataFrame) -> tuple[tuple[float, float], DataFrame | None]:
    """(tilt, threshold) for a board, from labelled rows (game_id, player_id, snapshot_ts, line_value, over_hit, pmf).

    The tilt is chosen on the earlier groups and is none unless it helps the later ones. The curve of over prices is
    fitted on the earlier groups' tilted prices, so the later groups stay unseen by it. A history of fewer than
    LEAST_GROUPS groups gives neither: no tilt and no curve.
    """
    rows = settled(rows)
    if rows.select("game_id", "player_id").distinct().count() < C.LEAST_GROUPS:
        return (1.0, 0.0), None
    split = settled(C.guarded_holdout(rows, ["game_id", "player_id"], "snapshot_ts"))
    early, late = split.where("not is_eval"), split.where("is_eval")
    found = D.fit_tilt(early, late)
    tilt = (found["tau"], found["lam"]) if found["accepted"] else (1.0, 0.0)
    tilted = early.withColumn("pmf", PMF.tilt(F.col("pmf"), F.lit(tilt[0]), F.lit(tilt[1])))
    return tilt, settled(PO.fit_curves(with_over(tilted, "p").select("p", F.col("over_hit").alias("y"), F.lit(0).alias("_curve")), ["_curve"]))


def _universe(spark, d, fitted: bool = False) -> Board:
    events = pa_view(spark, d)
    last = table(spark, d, "events").agg(F.max(F.to_date("ts"))).first()[0]
    before = FR.as_of(events.withColumn("day", F.to_date("ts")), "day", F.lit(last)).drop("day")
    states = with_names(B.distributions(B.states(before)), "player_id").select("player_id", "player_name", "pmf")
    tilt, threshold, start = TILT, THRESHOLD, FITTED_FROM if fitted else OPEN_FROM
    if fitted:
        past = M.labels(M.evaluation_quotes(quote_view(spark, d)).where(F.year("commence_time") < start))
        tilt, threshold = fit_board_curves(past.join(states.select("player_id", "pmf"), "player_id"))
    quotes = with_names(quote_view(spark, d), "player_id").withColumn("player_id", F.when(F.col("player_id") % 4 != 0, F.col("player_id")))
    return universe_board(open_quotes(quotes, F.year("commence_time") >= start, "primary"), states, tilt, threshold)


def _states_sql(before: str) -> str:
    """CTEs up to m (player_id, pmf): the binomial of the last rate and the mean session, folded to B.CELLS cells."""
    last = B.CELLS - 1
    return f"""pa AS ({PA_SQL}), seen AS (SELECT * FROM pa {before}),
 r AS (SELECT *, CASE WHEN count(is_strikeout) OVER w >= {X.least_observations(30)} THEN avg(is_strikeout) OVER w END AS rate FROM seen WINDOW w AS (PARTITION BY pitcher_id ORDER BY ts, event_id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
 one AS (SELECT pitcher_id, least(greatest(coalesce(rate, {B.PRIOR_RATE}), 1e-4), 0.95)::DOUBLE AS p FROM r QUALIFY row_number() OVER (PARTITION BY pitcher_id ORDER BY ts DESC, event_id DESC) = 1),
 num AS (SELECT pitcher_id, least(36, greatest(1, round_even(avg(bf), 0)))::BIGINT AS n FROM (SELECT pitcher_id, game_id, count(*) AS bf FROM seen GROUP BY ALL) GROUP BY pitcher_id),
 raw AS (SELECT pitcher_id, list_transform(range(0, n + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(p) + (n - k) * ln(1 - p))) AS f FROM one JOIN num USING (pitcher_id)),
 m AS (SELECT pitcher_id AS player_id, list_transform(range(0, {B.CELLS}), lambda k: CASE WHEN k < {last} THEN coalesce(f[k + 1], 0.0::DOUBLE) ELSE coalesce(list_sum(f[{B.CELLS}:]), 0.0::DOUBLE) END) AS pmf FROM raw)"""


def _over_sql(line: str, op: str = ">") -> str:
    return f"list_sum(list_transform(range(0, {B.CELLS}), lambda k: CASE WHEN k {op} {line} THEN pmf[k + 1] ELSE 0.0::DOUBLE END))"


_MEAN = f"list_sum(list_transform(range(0, {B.CELLS}), lambda k: k * pmf[k + 1]))"


def _quantile_sql(q: float) -> str:
    return f"least({B.CELLS - 1}, len(list_filter(range(0, {B.CELLS}), lambda k: list_sum(pmf[:k + 1]) < {q} - 1e-12)))::INTEGER"


def _between_sql(p: str) -> str:
    """THRESHOLD applied to p."""
    k, v = THRESHOLD.knots, THRESHOLD.values
    pieces = " ".join(f"WHEN {p} < {k[i + 1]} THEN {v[i]} + ({v[i + 1]} - {v[i]}) * ({p} - {k[i]}) / ({k[i + 1]} - {k[i]})" for i in range(len(k) - 1))
    return f"(CASE WHEN {p} < {k[0]} THEN {v[0]}::DOUBLE {pieces} ELSE {v[-1]}::DOUBLE END)"


def _fair_sql(p: str) -> str:
    q = f"least(greatest({p}, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE)"
    return f"(CASE WHEN {q} >= 0.5 THEN -100 * {q} / (1 - {q}) ELSE 100 * (1 - {q}) / {q} END)"


UNIVERSE = f"""{TWO_SIDED}, open AS (SELECT * EXCLUDE (player_id, model_over_prob), 'p' || player_id AS player_name, CASE WHEN player_id % 4 <> 0 THEN player_id END AS player_id FROM two
  WHERE snapshot_ts < commence_time AND prop_type = 'primary' AND extract(YEAR FROM commence_time) >= 1994),
 qs AS (SELECT * FROM open QUALIFY row_number() OVER (PARTITION BY game_id, player_name, vendor, line_value ORDER BY snapshot_ts DESC NULLS LAST, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC) = 1),
 {_states_sql("WHERE CAST(ts AS DATE) < (SELECT max(CAST(ts AS DATE)) FROM events)")},
 t AS (SELECT player_id, 'p' || player_id AS player_name, list_transform(range(0, {B.CELLS}), lambda k: exp(ln(greatest(pmf[k + 1], 1e-12)) / {TILT[0]} + {TILT[1]} * k)) AS z FROM m),
 u AS (SELECT player_id, player_name, list_transform(z, lambda x: x / list_sum(z)) AS pmf FROM t),
 en AS (SELECT game_id, player_name, min(player_id) AS player_id FROM qs GROUP BY ALL),
 found AS (SELECT en.game_id, en.player_name, coalesce(a.pmf, b.pmf) AS pmf FROM en LEFT JOIN u a ON a.player_id = en.player_id LEFT JOIN u b ON b.player_name = en.player_name WHERE coalesce(a.pmf, b.pmf) IS NOT NULL)"""
_P_OVER = _between_sql(_over_sql("line_value"))


def summary_sql(base: str, kind: str = "") -> str:
    """The summary over CTEs qs (quotes) and found (entries); `kind` is the join's, RIGHT to keep entries without quotes."""
    return f"""{base}, g AS (SELECT game_id, player_name, count(*) AS top_quote_count, count(DISTINCT vendor) AS vendor_count,
  arg_min(line_value, (abs(market_over_prob - 0.5), snapshot_ts, line_value, vendor)) AS market_mean FROM qs GROUP BY ALL)
 SELECT game_id, player_name, coalesce(top_quote_count, 0) AS top_quote_count, coalesce(vendor_count, 0) AS vendor_count, market_mean, round({_MEAN}, 6) AS k_mean, {_quantile_sql(0.5)} AS k_median, {_quantile_sql(0.8)} AS k_p80, {_quantile_sql(0.9)} AS k_p90,
  round(market_mean - {_MEAN}, 6) AS market_mean_shift FROM g {kind} JOIN found USING (game_id, player_name)"""


@register("universe_summary", summary_sql(UNIVERSE))
def universe_summary(spark, d):
    return r6(_universe(spark, d).summary)


def bets_sql(base: str) -> str:
    """The bets over CTEs qs (quotes) and found (entries)."""
    return f"""{base}, b AS (SELECT *, {_P_OVER} AS model_over_prob FROM qs JOIN found USING (game_id, player_name)),
 v AS (SELECT *, {_ev("model_over_prob", "over_odds")} AS over_ev, {_ev("(1 - model_over_prob)", "under_odds")} AS under_ev, abs(model_over_prob - 0.5) AS conf_dist FROM b),
 w AS (SELECT *, greatest(over_ev, under_ev) AS best_ev, greatest(over_ev, under_ev) >= 0.2 AND conf_dist >= 0.1 AS passes_strict_ev_gate FROM v)
 SELECT game_id, player_name, vendor, line_value, over_odds, under_odds, CASE WHEN over_ev >= under_ev THEN 'over' ELSE 'under' END AS best_side, round(best_ev, 6) AS best_ev, round(over_ev, 6) AS over_ev, round(under_ev, 6) AS under_ev,
  round(model_over_prob, 6) AS model_over_prob, round(market_over_prob, 6) AS market_over_prob, round(conf_dist, 6) AS conf_dist, passes_strict_ev_gate, CASE WHEN passes_strict_ev_gate THEN 'BET' ELSE 'PASS' END AS action_tier FROM w"""


BET_COLUMNS = (
    *ENTRY, "vendor", "line_value", "over_odds", "under_odds", "best_side", "best_ev", "over_ev", "under_ev", "model_over_prob", "market_over_prob", "conf_dist", "passes_strict_ev_gate", "action_tier",
)


@register("universe_bets", bets_sql(UNIVERSE))
def universe_bets(spark, d):
    return r6(_universe(spark, d).bets.select(*BET_COLUMNS))


@register("universe_lines", f"""{UNIVERSE}, c AS (SELECT DISTINCT game_id, player_name, line_value FROM qs), o AS (SELECT game_id, player_name, line_value, {_P_OVER} AS p_over FROM c JOIN found USING (game_id, player_name))
 SELECT game_id, player_name, line_value, round(p_over, 6) AS p_over, round(1 - p_over, 6) AS p_under, 0.0::DOUBLE AS p_push, round({_fair_sql("p_over")}, 4) AS fair_over, round({_fair_sql("(1 - p_over)")}, 4) AS fair_under FROM o""")
def universe_lines(spark, d):
    lines = _universe(spark, d).lines
    return r6(lines.withColumns({c: F.round(c, 4) for c in ("fair_over", "fair_under")}))


@register("universe_exact", f"""{UNIVERSE} SELECT game_id, player_name, k::INTEGER AS strikeouts, round(pmf[k + 1], 6) AS probability, round({_fair_sql("pmf[k + 1]")}, 2) AS fair FROM found, unnest(range(0, {B.CELLS})) x(k)""")
def universe_exact(spark, d):
    return r6(_universe(spark, d).exact.withColumn("fair", F.round("fair", 2)))


@register("fitted_universe_bets")
def fitted_universe_bets(spark, d):
    """The bets by a tilt and a curve that are fitted on quotes of earlier years; a test holds them against numpy."""
    return r6(_universe(spark, d, fitted=True).bets.select(*BET_COLUMNS))


_INTEGER_FAIR = "(CASE WHEN {0} >= 0.5 THEN round_even(-100 * {0} / (1 - {0}), 0) ELSE round_even(100 * (1 - {0}) / {0}, 0) END)::BIGINT"
_BOUNDED = "least(greatest({0}, 1e-9::DOUBLE), 1 - 1e-9::DOUBLE)"

ORACLE_SQL["board_flagship"] = f"""{EVALUATED}, {_states_sql("")},
 b AS (SELECT ev.* EXCLUDE (model_over_prob), pmf, {_over_sql("line_value")} / ({_over_sql("line_value")} + {_over_sql("line_value", "<")}) AS model_over_prob FROM ev JOIN m USING (player_id)),
 v AS (SELECT *, {_ev("model_over_prob", "over_odds")} AS over_ev, {_ev("(1 - model_over_prob)", "under_odds")} AS under_ev, abs(model_over_prob - 0.5) AS conf_dist, {_BOUNDED.format("model_over_prob")} AS po, {_BOUNDED.format("(1 - model_over_prob)")} AS pu FROM b),
 w AS (SELECT *, greatest(over_ev, under_ev) AS best_ev FROM v)
 SELECT game_id, player_id, vendor, line_value, over_odds, under_odds, round(model_over_prob, 6) AS model_over_prob, round(market_over_prob, 6) AS market_over_prob, CASE WHEN over_ev >= under_ev THEN 'over' ELSE 'under' END AS best_side,
  round(best_ev, 6) AS best_ev, round(conf_dist, 6) AS conf_dist, best_ev >= 0.2 AND conf_dist >= 0.1 AS passes_strict_ev_gate,
  CASE WHEN best_ev >= 0.2 AND conf_dist >= 0.1 THEN 'bet' WHEN best_ev > 0 THEN 'watch' ELSE 'pass' END AS action_tier, {_INTEGER_FAIR.format("po")} AS fair_over_odds, {_INTEGER_FAIR.format("pu")} AS fair_under_odds,
  round({_MEAN}, 6) AS k_mean, {_quantile_sql(0.5)} AS k_p50, {_quantile_sql(0.8)} AS k_p80, {_quantile_sql(0.9)} AS k_p90 FROM w"""


@register("residual_sweep")
def residual_sweep(spark, d):
    rows = M.main_lines(evaluated(spark, d)).select("game_id", "player_id", "snapshot_ts", F.col("model_over_prob").alias("p"), "market_over_prob", F.col("over_hit").alias("y"))
    # Nine calibrators are fitted and scored on these rows.
    split = settled(C.group_holdout(settled(rows), ["game_id", "player_id"], "snapshot_ts"))
    accepted, chosen, found = CAL.residual_sweep(split.where("not is_eval"), split.where("is_eval"))
    table_ = [(r["name"], r["name"] == chosen, accepted, *(float(r[c]) for c in CAL.RESIDUAL_METRICS)) for r in found]
    return r6(spark.createDataFrame(table_, f"name string, chosen boolean, accepted boolean, {', '.join(c + ' double' for c in CAL.RESIDUAL_METRICS)}"), 4)
