"""Queries over whole frames of features: medians and rank correlations of all columns at once, and states as of many days."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import odds as O
from ..operators import features as X
from ..operators import ranges as R
from .catalogue import PA, QUOTES, r6, register
from .views import pa_view, quote_view

#: Names of the rolling columns, by measure.
RATES = {"is_strikeout": "k_rate", "is_walk": "walk_rate", "is_hit": "hit_rate", "is_out": "out_rate", "avg_release_speed": "velo"}
ENTITIES = ("pitcher", "batter")
ROLLED = [(e, m, n, f"{e}_{r}_{n}") for e in ENTITIES for m, r in RATES.items() for n in X.WINDOWS]

_WINDOWS = ", ".join(f"{e}{n} AS (PARTITION BY {e}_id ORDER BY ts, event_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for e in ENTITIES for n in X.WINDOWS)
_COLUMNS = ", ".join(f"CASE WHEN count({m}) OVER {e}{n} >= {X.least_observations(n)} THEN avg({m}) OVER {e}{n} END AS {c}" for e, m, n, c in ROLLED)
ROLLED_SQL = f"{PA}, rolled AS (SELECT event_id, is_strikeout, {_COLUMNS} FROM pa WINDOW {_WINDOWS})"


def rolled(spark, d):
    """Events with the rolling columns under the names by which they are filled."""
    events = pa_view(spark, d)
    for e in ENTITIES:
        events = X.rolling_rates(events, f"{e}_id", tuple(RATES))
    return events.select("event_id", "is_strikeout", *(F.col(f"{e}_id_{m}_{n}").alias(c) for e, m, n, c in ROLLED))


@register("named_median_fill", f"{ROLLED_SQL}, m AS (SELECT {', '.join(f'median({c}) AS {c}' for *_, c in ROLLED)} FROM rolled) SELECT event_id, is_strikeout, {', '.join(f'round(coalesce(rolled.{c}, m.{c}), 9) + 0.0::DOUBLE AS {c}' for *_, c in ROLLED)} FROM rolled, m")
def named_median_fill(spark, d):
    """Medians of thirty columns, found by their names, in one pass."""
    return r6(R.fill_medians(rolled(spark, d)), 9)


_RANKS = " UNION ALL ".join(f"SELECT '{c}' AS feature, round(CAST({c} AS DOUBLE), 9) AS x, CAST(is_strikeout AS DOUBLE) AS y FROM rolled" for *_, c in ROLLED)


@register("feature_signal", f"""{ROLLED_SQL}, f AS ({_RANKS}), s AS (SELECT feature, count(x) AS known, avg(CASE WHEN x IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS missing_rate, stddev_pop(x) AS std FROM f GROUP BY feature HAVING count(x) >= 100),
 r AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0::DOUBLE AS b FROM f WHERE x IS NOT NULL AND y IS NOT NULL),
 c AS (SELECT feature, count(*) AS n, corr(a, b) AS spearman FROM r GROUP BY feature) SELECT feature, n, round(spearman, 6) + 0.0::DOUBLE AS spearman, round(missing_rate, 6) + 0.0::DOUBLE AS missing_rate, round(std, 6) + 0.0::DOUBLE AS std FROM s JOIN c USING (feature)""")
def feature_signal(spark, d):
    """The rank correlation of every rolling column with the outcome. Means that differ in their last bits alone are ties."""
    return r6(R.rank_correlations(r6(rolled(spark, d), 9), [c for *_, c in ROLLED], "is_strikeout"))


#: Quotes of the many-day board fall on these days of the events, and name their pitchers.
QUOTE_DAYS, PITCHERS = 30, 50
_QUOTED = f"(SELECT *, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(l_orderkey % {QUOTE_DAYS} AS INTEGER)) AS quote_day, CAST(l_partkey % {PITCHERS} AS BIGINT) AS pitcher_id FROM q)"
_STATE_COLUMNS = ("event_id", "seen", "hits_so_far", "k_rate_30")
_STATES = f"s AS (SELECT pitcher_id, ts, event_id, row_number() OVER w AS seen, CAST(sum(is_hit) OVER w AS BIGINT) AS hits_so_far, avg(is_strikeout) OVER (PARTITION BY pitcher_id ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS k_rate_30 FROM pa WINDOW w AS (PARTITION BY pitcher_id ORDER BY ts, event_id))"


def day_states(spark, d):
    """Quotes, each with its pitcher's state after the last event before the quote's own day."""
    w = Window.partitionBy("pitcher_id").orderBy("ts", "event_id")
    events = pa_view(spark, d).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    states = events.select("pitcher_id", "ts", "event_id", F.row_number().over(w).alias("seen"), F.sum("is_hit").over(w).alias("hits_so_far"), F.avg("is_strikeout").over(w.rowsBetween(-29, 0)).alias("k_rate_30"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("l_orderkey") % QUOTE_DAYS).cast("int")).cast("timestamp_ntz")
    quotes = quote_view(spark, d).select("l_orderkey", "l_linenumber", "l_suppkey", "line_value", "over_odds", "under_odds", day.alias("quote_day"), (F.col("player_id") % PITCHERS).alias("pitcher_id"))
    return R.as_of(quotes, states, ["pitcher_id"], "quote_day", "ts", _STATE_COLUMNS, ["event_id"])


@register("asof_states", f"{QUOTES}, pa AS ({PA[len('WITH pa AS ('):-1]}), {_STATES} SELECT l_orderkey, l_linenumber, l_suppkey, pitcher_id, event_id, CAST(seen AS INTEGER) AS seen, hits_so_far, round(k_rate_30, 6) AS k_rate_30 FROM {_QUOTED.replace('l_partkey', 'player_id')} q ASOF LEFT JOIN s ON q.pitcher_id = s.pitcher_id AND q.quote_day > s.ts".replace("SELECT l_orderkey, l_linenumber, l_suppkey, pitcher_id", "SELECT l_orderkey, l_linenumber, l_suppkey, q.pitcher_id"))
def asof_states(spark, d):
    return r6(day_states(spark, d).select("l_orderkey", "l_linenumber", "l_suppkey", "pitcher_id", *_STATE_COLUMNS))


_OVER_P = "(CASE WHEN over_odds > 0 THEN 100.0E0 / (over_odds + 100.0E0) ELSE -over_odds / (100.0E0 - over_odds) END)"


@register("many_day_board", f"""{QUOTES}, pa AS ({PA[len('WITH pa AS ('):-1]}), {_STATES}, j AS (SELECT q.*, s.event_id, s.k_rate_30 FROM {_QUOTED.replace('l_partkey', 'player_id')} q ASOF LEFT JOIN s ON q.pitcher_id = s.pitcher_id AND q.quote_day > s.ts)
 SELECT CAST(quote_day AS DATE) AS day, count(*) AS quotes, count(event_id) AS with_state, count(DISTINCT pitcher_id) AS pitchers, round(avg(k_rate_30), 6) AS mean_rate, round(avg({_OVER_P}), 6) AS mean_implied, round(avg(k_rate_30 - {_OVER_P} / line_value), 6) + 0.0::DOUBLE AS mean_gap FROM j GROUP BY 1""")
def many_day_board(spark, d):
    """One row for each day of quotes, every day by the states before it."""
    implied = O.implied_probability(F.col("over_odds"))
    rows = day_states(spark, d).groupBy(F.to_date("quote_day").alias("day"))
    return r6(rows.agg(F.count(F.lit(1)).alias("quotes"), F.count("event_id").alias("with_state"), F.countDistinct("pitcher_id").alias("pitchers"), F.avg("k_rate_30").alias("mean_rate"), F.avg(implied).alias("mean_implied"), F.avg(F.col("k_rate_30") - implied / F.col("line_value")).alias("mean_gap")))
