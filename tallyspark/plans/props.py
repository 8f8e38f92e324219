"""Registered queries of flat props, rows for gates, confirmation across vendors, the wider split and the test of uniformity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import market as M
from ..operators import metrics as S
from ..operators import selection as C
from ..operators import splits as SP
from ..sources import scans as SC
from .boards import FITTED_FROM
from .catalogue import _CELL_COLS, EVALUATED, evaluated, r6, register
from .views import QUOTE_SQL, quote_view, table

_DUCK_QUOTES = QUOTE_SQL.replace("AS STRING", "AS VARCHAR")


@register("market_quotes", f"""WITH q AS ({_DUCK_QUOTES})
 SELECT game_id, player_id, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE vendor END AS vendor, CASE WHEN l_linenumber % 4 = 0 THEN 'primary' ELSE prop_type END AS prop_type,
  CASE WHEN l_suppkey % 5 = 0 THEN 0 ELSE line_value END AS line_value, over_odds::BIGINT AS over_odds, under_odds::BIGINT AS under_odds,
  CASE WHEN l_orderkey % 3 = 1 THEN 100 + l_suppkey % 50 END AS milestone_odds FROM q WHERE l_orderkey % 11 <> 0""")
def market_quotes(spark, d):
    """Quotes nested as a service sends them, as JSON, and flattened."""
    kind = F.when(F.col("l_orderkey") % 3 == 0, "over_under").when(F.col("l_orderkey") % 3 == 1, "milestone")
    market = F.struct(kind.alias("type"), (F.col("over_odds") + F.signum("over_odds") * 0.4).alias("over_odds"), F.col("under_odds").cast("double").alias("under_odds"), (100 + F.col("l_suppkey") % 50).cast("double").alias("odds"))
    sent = quote_view(spark, d).select(F.to_json(F.struct(
        F.when(F.col("l_orderkey") % 11 != 0, F.col("game_id")).alias("game_id"), "player_id", F.when(F.col("l_linenumber") % 3 != 0, F.col("vendor")).alias("vendor"),
        F.when(F.col("l_linenumber") % 4 != 0, F.col("prop_type")).alias("prop_type"), F.when(F.col("l_suppkey") % 5 != 0, F.col("line_value")).alias("line_value"), market.alias("market"),
    )).alias("text"))
    rows = sent.select(F.from_json("text", SC.PROPS_SCHEMA).alias("r")).select("r.*")
    return SC.market_quotes(rows, "primary").drop("updated_at")


_GIVEN = "CASE l_suppkey % 4 WHEN 0 THEN ' OVER' WHEN 1 THEN 'un' WHEN 2 THEN 'u' ELSE 'push' END"
_GATED = "game_id, player_id, vendor, line_value, l_orderkey, l_linenumber, l_suppkey, side, round(best_ev, 6) + 0.0 AS best_ev, round(CASE WHEN side = 'over' THEN model_over_prob ELSE 1 - model_over_prob END, 6) AS model_prob, round(CASE WHEN side = 'over' THEN market_over_prob ELSE 1 - market_over_prob END, 6) AS market_prob, (CASE WHEN side = 'over' THEN over_hit ELSE 1 - over_hit END)::DOUBLE AS actual, round(abs(model_over_prob - 0.5), 6) AS conf_dist"
_GATED_COLUMNS = ("game_id", "player_id", "vendor", "line_value", "l_orderkey", "l_linenumber", "l_suppkey", "side", "best_ev", "model_prob", "market_prob", "actual", "conf_dist")


@register("gate_rows_given", f"""{EVALUATED}, g AS (SELECT *, CASE l_suppkey % 4 WHEN 0 THEN 'over' WHEN 3 THEN NULL ELSE 'under' END AS side FROM cand WHERE l_orderkey % 6 <> 0) SELECT {_GATED} FROM g WHERE side IS NOT NULL""")
def gate_rows_given(spark, d):
    """The side is given as vendors write it; an infinite value counts as missing."""
    rows = evaluated(spark, d).withColumns({"given": F.expr(_GIVEN), "actual_over": F.col("over_hit"), "best_ev": F.when(F.col("l_orderkey") % 6 == 0, float("inf")).otherwise(F.col("best_ev"))})
    return r6(C.gate_rows(rows, "given").select(*_GATED_COLUMNS))


@register("gate_rows_derived", f"""{EVALUATED}, g AS (SELECT *, CASE WHEN coalesce(CASE WHEN l_orderkey % 5 <> 0 THEN over_ev END, '-Infinity'::DOUBLE) >= coalesce(CASE WHEN l_orderkey % 4 <> 0 THEN under_ev END, '-Infinity'::DOUBLE) THEN 'over' ELSE 'under' END AS side FROM cand) SELECT {_GATED} FROM g""")
def gate_rows_derived(spark, d):
    """The side follows from both values, of which some are missing."""
    rows = evaluated(spark, d).withColumns({"actual_over": F.col("over_hit"), "over_ev": F.when(F.col("l_orderkey") % 5 != 0, F.col("over_ev")), "under_ev": F.when(F.col("l_orderkey") % 4 != 0, F.col("under_ev"))})
    return r6(C.gate_rows(rows).select(*_GATED_COLUMNS))


@register("confirmations", f"""{EVALUATED} SELECT game_id, player_id, line_value, best_side, count(DISTINCT vendor) AS books, round(avg(best_ev), 6) + 0.0 AS mean_ev, round(median(best_ev), 6) + 0.0 AS median_ev FROM cand GROUP BY ALL""")
def confirmations(spark, d):
    """Vendors that agree on a bet, with mean and median of its value."""
    return r6(C.books(evaluated(spark, d)))


@register("wide_split", """WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), r AS (SELECT day, row_number() OVER (ORDER BY day) AS place, count(*) OVER () AS n FROM d),
 p AS (SELECT day, CASE WHEN place > n - greatest(5, round_even(n * 0.2, 0)) THEN 'evaluate' WHEN place > n - 2 * greatest(5, round_even(n * 0.2, 0)) THEN 'calibrate' ELSE 'train' END AS part FROM r)
 SELECT event_id, part FROM events JOIN p ON CAST(ts AS DATE) = day""")
def wide_split(spark, d):
    """A fifth of the days each to calibrate and to evaluate, five at least, of 20 or more."""
    return SP.out_of_time(table(spark, d, "events"), F.to_date("ts"), 0.20, 0.20, 5, 20).select("event_id", "part")


_DRAW = "((l_partkey * 7919 + l_orderkey * 104729 + l_linenumber * 31) % 10007 + 5E-1) / 10007"


@register("ks_report", f"""WITH t AS (SELECT ({_DRAW})::DOUBLE AS p FROM lineitem), c AS (SELECT p, count(*) AS n FROM t GROUP BY p), b AS (SELECT p, n, sum(n) OVER (ORDER BY p) AS cn, sum(n) OVER () AS total FROM c),
 k AS (SELECT max(greatest(cn / total - p, p - (cn - n) / total)) AS ks, sum(n)::BIGINT AS n FROM b), x AS (SELECT *, (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * ks AS x FROM k)
 SELECT n, round(ks, 6) AS ks, round(CASE WHEN x <= 0.2 THEN 1 ELSE least(1, greatest(0, 2 * list_sum([CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * j * j * x * x) FOR j IN range(1, 101)]))) END, 6)::DOUBLE AS p_value FROM x""")
def ks_report(spark, d):
    """Distance from uniform with its p-value, of draws that are nearly so."""
    rows = table(spark, d, "lineitem").select(F.expr(_DRAW).cast("double").alias("p"))
    found = S.ks_uniform(rows).crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("n"))))  # one row each
    return r6(found.select("n", "ks", S.kolmogorov_p(F.col("ks"), F.col("n")).alias("p_value")))


def labelled_candidates(quotes):
    """Both sides of quotes as board candidates with `won`; pushes count as lost, quotes without a result are left out."""
    rows = M.board_candidates(M.labels(quotes.where("actual_total_k IS NOT NULL")))
    return rows.withColumn("won", F.when(F.col("bet_side") == "over", F.col("over_hit")).otherwise(F.col("under_hit")))


@register("learned_candidates")
def learned_candidates(spark, d):
    """Candidates of the later quotes with the score of a filter that learned from the earlier ones' candidates."""
    quotes = M.latest_quotes(M.pregame(quote_view(spark, d)))
    earlier = F.year("commence_time") < FITTED_FROM
    scored = C.learned_filter(labelled_candidates(quotes.where(earlier)), M.board_candidates(quotes.where(~earlier)))
    return scored.select(*_CELL_COLS, "bet_side", F.round("selection_score", 3).alias("selection_score"), "pass_rules", "selected")
