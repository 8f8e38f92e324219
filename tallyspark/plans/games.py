"""Boards of a day's games, before them and while they run, and the composed reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pmf as PMF
from ..operators import diagnostics as D
from ..operators import features as X
from ..operators import frames as FR
from ..operators import market as M
from ..operators import metrics as S
from ..operators import selection as C
from . import board as B
from .boards import BET_COLUMNS, THRESHOLD, _states_sql, bets_sql, open_quotes, priced_board, summary_sql, with_names
from .catalogue import _LOGITS, EVALUATED, ORACLE_SQL, TWO_SIDED, evaluated, logits_pmf, r6, register, scored
from .views import pa_view, quote_view

#: Statuses of games that a live board leaves out.
FINISHED = ("STATUS_FINAL", "STATUS_POSTPONED", "STATUS_CANCELED")
PLACES = 9
LOW, HIGH = 1e-4, 0.95
SIDE = ("game_id", "half_inning")


def line_ups(events: DataFrame) -> DataFrame:
    """(game_id, half_inning, batter_id): the first PLACES batters of each side by their first event."""
    places = X.lineup_order(events.where(F.col("batter_id").isNotNull()), list(SIDE), "batter_id")
    return places.select(*SIDE, F.explode(F.slice("lineup", 1, PLACES)).alias("batter_id"))


def met_rates(lineups: DataFrame, history: DataFrame) -> DataFrame:
    """(game_id, half_inning, lineup_rate): the mean of the batters' last rates over 60 events; sides without batters have no row."""
    rated = X.rolling_rates(history, "batter_id", ["is_strikeout"], [60])
    last = X.latest_row(rated, ["batter_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("batter_id", F.col("batter_id_is_strikeout_60").alias("rate"))
    return lineups.join(last, "batter_id", "left").groupBy(*SIDE).agg(F.avg("rate").alias("lineup_rate"))


def game_entries(pitchers: DataFrame, so_far: DataFrame | None, lineups: DataFrame, history: DataFrame) -> DataFrame:
    """(game_id, pitcher_id, pmf) of pitchers (game_id, half_inning, pitcher_id) who meet a line-up and have a history.

    A step's rate is the mean of the pitcher's and the line-up's, and as many steps are left as the pitcher's sessions
    have in the mean, less those already faced, one at least. What is counted `so_far` (game_id, pitcher_id, bf, k) is
    added to the count.
    """
    states = B.states(history).withColumnRenamed("player_id", "pitcher_id")
    found = pitchers.join(met_rates(lineups, history), list(SIDE)).join(states, "pitcher_id")
    if so_far is None:
        found = found.withColumns({"bf": F.lit(0), "k": F.lit(0)})
    else:
        found = found.join(so_far, ["game_id", "pitcher_id"])
    own = F.least(F.greatest("rate", F.lit(LOW)), F.lit(HIGH))
    rate = (own + F.coalesce("lineup_rate", F.lit(B.PRIOR_RATE))) / 2
    left = F.greatest(F.col("expected_bf") - F.col("bf"), F.lit(1)).cast("int")
    rest = PMF.poisson_binomial(F.array_repeat(rate, left), LOW, HIGH)
    return found.select("game_id", "pitcher_id", PMF.fold_tail(F.concat(F.array_repeat(F.lit(0.0), F.col("k").cast("int")), rest), B.CELLS).alias("pmf"))


def pregame_entries(events: DataFrame, history: DataFrame) -> DataFrame:
    """Entries of the probable starters, the first pitcher of each side."""
    first = X.latest_row(events.where(F.col("pitcher_id").isNotNull()), list(SIDE), [F.col("pa_number").asc(), F.col("event_id").asc()])
    return game_entries(first.select(*SIDE, "pitcher_id"), None, line_ups(events), history)


def live_entries(games: DataFrame, seen: DataFrame, lineups: DataFrame, history: DataFrame) -> DataFrame:
    """Entries of the active pitchers of running games: `seen` are the events up to now, `games` (game_id, status)."""
    running = FR.without_status(games, "status", FINISHED).select("game_id")
    now = seen.join(running, "game_id", "left_semi")
    so_far = now.groupBy("game_id", "pitcher_id").agg(F.count(F.lit(1)).alias("bf"), F.sum("is_strikeout").alias("k"))
    return game_entries(FR.active(now, list(SIDE), "pitcher_id", ["pa_number", "event_id"]), so_far, lineups, history)


# --- queries ----------------------------------------------------------------------------------------------------------

#: The day's games are those of one week; all weeks before it are history.
WEEK, SEEN = 2, 12


def _game_board(spark, d, live: bool):
    events = pa_view(spark, d)
    history, today = events.where(F.col("game_week") < WEEK), events.where(F.col("game_week") == WEEK)
    if live:
        status = F.when(F.col("game_id") % 7 == 0, "STATUS_FINAL").when(F.col("game_id") % 7 == 3, "status_postponed").otherwise("STATUS_IN_PROGRESS")
        games = today.select("game_id").distinct().withColumn("status", status)
        seen = today.where(F.col("pa_number") <= SEEN)
        entries = live_entries(games, seen, line_ups(seen), history)
    else:
        entries = pregame_entries(today, history)
    quotes = with_names(quote_view(spark, d), "player_id").withColumn("game_id", WEEK * 1000 + F.col("player_id") % 50)
    entries = with_names(entries, "pitcher_id").select("game_id", "player_name", "pmf")
    return priced_board(open_quotes(quotes, F.year("commence_time") >= 1994, "primary"), entries, THRESHOLD)


def _games_sql(live: bool) -> str:
    """CTEs up to qs (quotes) and found (entries)."""
    running = "AND game_id % 7 NOT IN (0, 3)"
    who = (
        f"lv AS (SELECT * FROM today WHERE pa_number <= {SEEN} {running}), sf AS (SELECT game_id, pitcher_id, count(*) AS bf, sum(is_strikeout) AS k FROM lv GROUP BY ALL), who AS (SELECT game_id, half_inning, arg_max(pitcher_id, (pa_number, event_id)) AS pitcher_id FROM lv GROUP BY ALL)"
        if live
        else "who AS (SELECT game_id, half_inning, arg_min(pitcher_id, (pa_number, event_id)) AS pitcher_id FROM today GROUP BY ALL), sf AS (SELECT game_id, pitcher_id, 0 AS bf, 0 AS k FROM who)"
    )
    last = B.CELLS - 1
    return f"""{TWO_SIDED}, open AS (SELECT * EXCLUDE (game_id, model_over_prob), {WEEK * 1000} + player_id % 50 AS game_id, 'p' || player_id AS player_name FROM two
  WHERE snapshot_ts < commence_time AND prop_type = 'primary' AND extract(YEAR FROM commence_time) >= 1994),
 qs AS (SELECT * FROM open QUALIFY row_number() OVER (PARTITION BY game_id, player_name, vendor, line_value ORDER BY snapshot_ts DESC NULLS LAST, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC) = 1),
 {_states_sql(f"WHERE game_week < {WEEK}")},
 today AS (SELECT * FROM pa WHERE game_week = {WEEK}),
 br AS (SELECT batter_id, CASE WHEN count(is_strikeout) OVER w >= {X.least_observations(60)} THEN avg(is_strikeout) OVER w END AS rate FROM seen WHERE batter_id IS NOT NULL
  WINDOW w AS (PARTITION BY batter_id ORDER BY ts, event_id ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) QUALIFY row_number() OVER (PARTITION BY batter_id ORDER BY ts DESC, event_id DESC) = 1),
 fb AS (SELECT game_id, half_inning, batter_id, min(pa_number) AS place FROM today WHERE {f"pa_number <= {SEEN} AND" if live else ""} batter_id IS NOT NULL GROUP BY ALL),
 lu AS (SELECT * FROM fb QUALIFY row_number() OVER (PARTITION BY game_id, half_inning ORDER BY place, batter_id) <= {PLACES}),
 lq AS (SELECT game_id, half_inning, avg(rate) AS lineup_rate FROM lu LEFT JOIN br USING (batter_id) GROUP BY ALL),
 {who},
 st AS (SELECT game_id, 'p' || pitcher_id AS player_name, k::BIGINT AS k, greatest(n - bf, 1)::BIGINT AS n, least(greatest((p + coalesce(lineup_rate, {B.PRIOR_RATE})) / 2, {LOW}), {HIGH})::DOUBLE AS p
  FROM who JOIN lq USING (game_id, half_inning) JOIN one USING (pitcher_id) JOIN num USING (pitcher_id) JOIN sf USING (game_id, pitcher_id)),
 rs AS (SELECT game_id, player_name, k AS shift, list_transform(range(0, n + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(p) + (n - j) * ln(1 - p))) AS f FROM st),
 cc AS (SELECT game_id, player_name, list_concat(list_transform(range(0, shift), lambda j: 0.0::DOUBLE), f) AS f FROM rs),
 found AS (SELECT game_id, player_name, list_transform(range(0, {B.CELLS}), lambda j: CASE WHEN j < {last} THEN coalesce(f[j + 1], 0.0::DOUBLE) ELSE coalesce(list_sum(f[{B.CELLS}:]), 0.0::DOUBLE) END) AS pmf FROM cc)"""


@register("pregame_summary", summary_sql(_games_sql(False), "RIGHT"))
def pregame_summary(spark, d):
    return r6(_game_board(spark, d, False).summary)


@register("pregame_bets", bets_sql(_games_sql(False)))
def pregame_bets(spark, d):
    return r6(_game_board(spark, d, False).bets.select(*BET_COLUMNS))


@register("live_summary", summary_sql(_games_sql(True), "RIGHT"))
def live_summary(spark, d):
    return r6(_game_board(spark, d, True).summary)


@register("live_bets", bets_sql(_games_sql(True)))
def live_bets(spark, d):
    return r6(_game_board(spark, d, True).bets.select(*BET_COLUMNS))


# --- reports ----------------------------------------------------------------------------------------------------------


def classifier_report(df: DataFrame) -> DataFrame:
    """One row of scores of (p, y)."""
    parts = [S.scores(df), S.roc_auc(df), S.average_precision(df), S.expected_calibration_error(df), S.spiegelhalter(df)]
    out = parts[0]
    for part in parts[1:]:  # one row each
        out = out.crossJoin(F.broadcast(part))
    return out


def pmf_report(df: DataFrame, key: str = "id") -> DataFrame:
    """One row over (id, pmf, actual): mean log score, mean ranked probability score, and the distance of the PIT from uniform."""
    chance = F.coalesce(F.try_element_at("pmf", F.col("actual").cast("int") + 1), F.lit(0.0))
    means = df.agg(F.avg(-F.log(F.greatest(chance, F.lit(1e-12)))).alias("pmf_log_score"), F.avg(PMF.ranked_probability_score(F.col("pmf"), F.col("actual"))).alias("pmf_rps"), F.count(F.lit(1)).alias("n"))
    return means.crossJoin(F.broadcast(S.ks_uniform(D.randomised_pit(df.withColumnRenamed(key, "id")).select("p")).withColumnRenamed("ks", "pit_ks_stat")))


def selection_report(rows: DataFrame) -> DataFrame:
    """One row over (selected, edge, ev): counts, and the means of what was selected."""
    chosen = F.col("selected") == 1
    return rows.agg(F.count(F.lit(1)).alias("candidate_count"), F.coalesce(F.sum("selected"), F.lit(0)).alias("selected_count"), F.avg(F.when(chosen, F.col("edge"))).alias("mean_edge_selected"), F.avg(F.when(chosen, F.col("ev"))).alias("mean_ev_selected"))


@register("classifier_report", f"SELECT * FROM ({ORACLE_SQL['log_loss_brier']}), ({ORACLE_SQL['auc']}), ({ORACLE_SQL['avg_precision']}), ({ORACLE_SQL['ece_quantile']}), ({ORACLE_SQL['spiegelhalter']})")
def classifier_report_query(spark, d):
    return r6(classifier_report(scored(spark, d)))


@register("pmf_report", f"""SELECT * FROM (SELECT count(*) AS n, round(avg(-ln(greatest(pmf[vec_id % 12 + 1], 1e-12))), 6) AS pmf_log_score,
  round(avg(list_sum(list_transform(range(0, 12), lambda k: power(list_sum(pmf[:k + 1]) - CASE WHEN k >= vec_id % 12 THEN 1 ELSE 0 END, 2))) / 12), 6) AS pmf_rps FROM ({_LOGITS} SELECT vec_id, pmf FROM f))""")
def pmf_report_query(spark, d):
    rows = logits_pmf(spark, d).select(F.col("vec_id").alias("id"), "pmf", (F.col("vec_id") % 12).alias("actual"))
    return r6(pmf_report(rows).drop("pit_ks_stat"))  # the PIT's draws are beyond SQL; pit_uniform has them


_SELECTED = "best_ev >= 0.2 AND conf_dist >= 0.1"


@register("selection_report", f"""{EVALUATED} SELECT count(*) AS candidate_count, count(*) FILTER (WHERE {_SELECTED}) AS selected_count,
 round(avg(conf_dist) FILTER (WHERE {_SELECTED}), 6) AS mean_edge_selected, round(avg(best_ev) FILTER (WHERE {_SELECTED}), 6) AS mean_ev_selected FROM cand""")
def selection_report_query(spark, d):
    rows = evaluated(spark, d).select(C.strict_gate().cast("int").alias("selected"), F.col("conf_dist").alias("edge"), F.col("best_ev").alias("ev"))
    return r6(selection_report(rows))


@register("market_report", f"""{EVALUATED} SELECT line_value, round(market_over_prob, 6) AS market_over_prob, round(1 - market_over_prob, 6) AS market_under_prob, over_hit AS actual_over, under_hit AS actual_under FROM cand""")
def market_report(spark, d):
    rows = M.labels(M.evaluation_quotes(quote_view(spark, d)))
    return r6(rows.select("line_value", "market_over_prob", (1 - F.col("market_over_prob")).alias("market_under_prob"), F.col("over_hit").alias("actual_over"), F.col("under_hit").alias("actual_under")))
