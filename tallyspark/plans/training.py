"""Frames that models and bet filters are fitted on: the merged frame of events, arrays of pitches, candidates with their
uncertainty, guarded holdouts and players found by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import market as M
from ..operators import matching as MT
from ..operators import ranges as R
from ..operators import selection as C
from ..operators.lineage import settled
from .catalogue import _CELL, _CELL_COLS, _EV, _OVER, _P, _PROFIT, _CLIP, _UNDER, EVALUATED, PA, QUOTES, _TIES, evaluated, r6, register
from .frames import _COLUMNS, _WINDOWS, ENTITIES, RATES, ROLLED
from .views import pa_view, quote_view, table

# --- the merged frame ---------------------------------------------------------------------------------------------------

#: A batter's rates that make up the quality of a line-up.
LINEUP_RATES = ("batter_k_rate_60", "batter_walk_rate_60", "batter_hit_rate_60")
_LINEUP = {f"lineup_mean_{c.removesuffix('_60')}": c for c in LINEUP_RATES}
_STATE = ("bf_so_far", *(f"{c}_so_far" for c in X.SUMS), "faced_before", "times_through")
_FILLED = ("days_rest", "avg_pitch_count_so_far", "avg_release_speed", *(c for *_, c in ROLLED), *_LINEUP)


def training_frame(events):
    """Events with their rolling rates, state, rest and line-up, nulls filled by the medians of their columns.

    Line-up means and rest are joined back to every event of their game and side, or pitcher and game. The rolling rates,
    which line-ups, medians and the frame itself read, are worked out and written once.
    """
    for e in ENTITIES:
        events = X.rolling_rates(events, f"{e}_id", tuple(RATES))
    events = settled(events.withColumnsRenamed({f"{e}_id_{m}_{n}": c for e, m, n, c in ROLLED}))
    events = X.state_so_far(events).withColumnRenamed("pitches_per_bf", "avg_pitch_count_so_far")
    events = events.withColumn("same_hand", F.coalesce(F.col("batter_side") == F.col("pitcher_hand"), F.lit(False)).cast("int"))
    side = ["game_id", "half_inning"]
    quality = X.lineup_quality(events, side, "batter_id", [*LINEUP_RATES, "same_hand"])
    quality = quality.select(*side, *(F.col(f"lineup_mean_{c}").alias(name) for name, c in _LINEUP.items()), F.col("lineup_mean_same_hand").alias("lineup_same_side_share"))
    rest = X.days_rest(events.withColumn("day", F.to_date("ts")), "pitcher_id", "game_id", "day").drop("day")
    return R.fill_medians(events.join(rest, ["pitcher_id", "game_id"], "left").join(quality, side, "left"))


_FIRSTS = ", ".join(f"arg_min({c}, (ts, event_id)) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in (*LINEUP_RATES, "same_hand"))
_SUMS = ", ".join(f"CAST(coalesce(sum({c}) OVER b, 0) AS BIGINT) AS {c}_so_far" for c in X.SUMS)
_MEDIANS = ", ".join(f"median({'pitch_count_pa' if c == 'avg_pitch_count_so_far' else c}) AS {c}" for c in _FILLED)
_MERGED = ("event_id", "season", *_STATE, "heavy_workload", "same_hand", *_FILLED, "lineup_same_side_share", "pitcher_mlbam_id", "batter_mlbam_id", "ext_pitcher_velo", "ext_pitcher_k_rate", "ext_batter_k_rate")

MERGED_SQL = f"""{PA}, w AS (SELECT *, {_COLUMNS}, row_number() OVER (PARTITION BY game_id, pitcher_id ORDER BY pa_number, event_id) - 1 AS bf_so_far, {_SUMS},
  row_number() OVER (PARTITION BY game_id, pitcher_id, batter_id ORDER BY pa_number, event_id) - 1 AS faced_before, CASE WHEN batter_side = pitcher_hand THEN 1 ELSE 0 END AS same_hand
  FROM pa WINDOW {_WINDOWS}, b AS (PARTITION BY game_id, pitcher_id ORDER BY pa_number, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 dr AS (SELECT pitcher_id, game_id, datediff('day', lag(day) OVER (PARTITION BY pitcher_id ORDER BY day, game_id), day) AS days_rest FROM (SELECT pitcher_id, game_id, min(CAST(ts AS DATE)) AS day FROM pa GROUP BY ALL)),
 fb AS (SELECT game_id, half_inning, batter_id, {_FIRSTS} FROM w WHERE batter_id IS NOT NULL GROUP BY ALL),
 lq AS (SELECT game_id, half_inning, {', '.join(f'avg({c}) AS {name}' for name, c in _LINEUP.items())}, avg(same_hand) AS lineup_same_side_share FROM fb GROUP BY ALL),
 fr AS (SELECT w.*, bf_so_far // 9 AS times_through, CASE WHEN pitch_count_pa_so_far >= 85 OR bf_so_far // 9 >= 2 THEN 1 ELSE 0 END AS heavy_workload, CASE WHEN bf_so_far > 0 THEN pitch_count_pa_so_far / bf_so_far END AS avg_pitch_count_so_far, days_rest, lq.* EXCLUDE (game_id, half_inning)
  FROM w LEFT JOIN dr USING (pitcher_id, game_id) LEFT JOIN lq USING (game_id, half_inning)),
 md AS (SELECT {_MEDIANS} FROM fr),
 ids AS (SELECT c_custkey AS player_id, c_custkey * 10 + c_nationkey % 10 AS mlbam_id FROM customer WHERE c_nationkey % 9 <> 4),
 xp AS (SELECT mlbam_id, game_week + 1 AS season, avg(avg_release_speed) AS ext_pitcher_velo, avg(is_strikeout) AS ext_pitcher_k_rate FROM pa JOIN ids ON pitcher_id = player_id GROUP BY ALL),
 xb AS (SELECT mlbam_id, game_week + 1 AS season, avg(is_strikeout) AS ext_batter_k_rate FROM pa JOIN ids ON batter_id = player_id GROUP BY ALL)
 SELECT event_id, game_week AS season, {', '.join(_STATE)}, heavy_workload, same_hand, {', '.join(f'round(CAST(coalesce(fr.{c}, md.{c}) AS DOUBLE), 9) + 0.0::DOUBLE AS {c}' for c in _FILLED)}, round(lineup_same_side_share, 9) AS lineup_same_side_share,
  ip.mlbam_id AS pitcher_mlbam_id, ib.mlbam_id AS batter_mlbam_id, round(ext_pitcher_velo, 9) AS ext_pitcher_velo, round(ext_pitcher_k_rate, 9) AS ext_pitcher_k_rate, round(ext_batter_k_rate, 9) AS ext_batter_k_rate
 FROM fr CROSS JOIN md LEFT JOIN ids ip ON ip.player_id = fr.pitcher_id LEFT JOIN ids ib ON ib.player_id = fr.batter_id
 LEFT JOIN xp ON xp.mlbam_id = ip.mlbam_id AND xp.season = game_week LEFT JOIN xb ON xb.mlbam_id = ib.mlbam_id AND xb.season = game_week"""


@register("merged_frame", MERGED_SQL)
def merged_frame(spark, d):
    """The training frame with external values of the season before; a week of the events stands for a season."""
    events = pa_view(spark, d).withColumn("season", F.col("game_week"))
    known = table(spark, d, "customer").where("c_nationkey % 9 <> 4")
    ids = known.select(F.col("c_custkey").alias("player_id"), (F.col("c_custkey") * 10 + F.col("c_nationkey") % 10).alias("mlbam_id"))

    def prior(entity, **values):
        named = events.join(ids, F.col(f"{entity}_id") == F.col("player_id"))
        return named.groupBy("mlbam_id", "season").agg(*(F.avg(c).alias(f"ext_{entity}_{name}") for name, c in values.items()))

    priors = {"pitcher": prior("pitcher", velo="avg_release_speed", k_rate="is_strikeout"), "batter": prior("batter", k_rate="is_strikeout")}
    return r6(X.merge_priors(training_frame(events), ids, priors).select(*_MERGED), 9)


# --- arrays of pitches --------------------------------------------------------------------------------------------------

#: Type codes by l_partkey % 8; one is empty and one missing.
CODES = ("FF", "SL", "CH", "SI", "", "CU", "XX")
_CODE_SQL = f"([{', '.join(repr(c) for c in CODES)}])[l_partkey % 8 + 1]"
_PITCH_ORDER = ("l_linenumber", "l_suppkey", "l_partkey")
_PITCHES = f"""p AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE WHEN l_linenumber % 5 <> 0 THEN l_quantity END AS release_speed, l_suppkey AS spin, CASE WHEN l_partkey % 3 <> 0 THEN round(l_discount * 100) END AS ivb,
  round(l_tax * 100) AS hmov, {_CODE_SQL} AS code, l_suppkey % 14 AS zone, CASE l_returnflag WHEN 'A' THEN 'S' WHEN 'R' THEN 'X' ELSE 'B' END AS call, CASE WHEN l_partkey % 4 = 0 THEN l_quantity + 50 END AS ev, CASE WHEN l_partkey % 4 = 0 THEN l_quantity > 25 END AS barrel FROM lineitem)"""


def _share_sql(codes) -> str:
    return f"round(count(*) FILTER (WHERE code IN ({', '.join(repr(c) for c in codes)})) / nullif(count(*) FILTER (WHERE code <> ''), 0), 6)"


def _last_sql(c: str) -> str:
    return f"(arg_max(struct_pack(x := {c}), ({', '.join(_PITCH_ORDER)}))).x"


@register("pitch_features", f"""WITH {_PITCHES} SELECT l_orderkey, CAST(count(*) AS INTEGER) AS pitch_count_pa, round(avg(release_speed), 6) AS avg_release_speed, round(avg(spin), 6) AS avg_spin_rate, round(avg(ivb), 6) + 0.0 AS avg_induced_vertical_break, round(avg(hmov), 6) + 0.0 AS avg_horizontal_movement,
  {_share_sql(('FF', 'SI', 'FC'))} AS fastball_share_pa, {_share_sql(('SL', 'CU', 'KC', 'SV'))} AS breaking_share_pa, {_share_sql(('CH', 'FS', 'FO', 'SC'))} AS offspeed_share_pa, round(count(*) FILTER (WHERE zone BETWEEN 1 AND 9) / count(*), 6) AS zone_rate_pa,
  CAST(count(*) FILTER (WHERE call IN ('S', 'X')) AS INTEGER) AS strikes_seen_pa, {_last_sql('release_speed')} AS last_release_speed, {_last_sql('code')} AS last_pitch_type_code, {_last_sql('CAST(spin AS DOUBLE)')} AS last_spin_rate, {_last_sql('CAST(zone AS INTEGER)')} AS last_strike_zone,
  {_last_sql('ivb')} + 0.0 AS last_ivb, {_last_sql('hmov')} + 0.0 AS last_hmov, {_last_sql('ev')} AS last_exit_velocity, CAST(NULL AS DOUBLE) AS last_launch_angle, CAST(coalesce({_last_sql('barrel')}, false) AS INTEGER) AS last_is_barrel FROM p GROUP BY l_orderkey""")
def pitch_features(spark, d):
    """Arrays of pitches built from the lines of an order."""
    c = F.col
    even = c("l_partkey") % 4 == 0
    fields = {
        "release_speed": F.when(c("l_linenumber") % 5 != 0, c("l_quantity")), "spin_rate": c("l_suppkey").cast("double"),
        "induced_vertical_break": F.when(c("l_partkey") % 3 != 0, F.round(c("l_discount") * 100)), "horizontal_movement": F.round(c("l_tax") * 100),
        "pitch_type_code": F.get(F.array(*map(F.lit, CODES)), (c("l_partkey") % 8).cast("int")), "strike_zone": (c("l_suppkey") % 14).cast("int"),
        "pitch_call": F.when(c("l_returnflag") == "A", "S").when(c("l_returnflag") == "R", "X").otherwise("B"),
        "exit_velocity": F.when(even, c("l_quantity") + 50), "is_barrel": F.when(even, c("l_quantity") > 25),
    }
    pitch = F.struct(*_PITCH_ORDER, *(column.alias(name) for name, column in fields.items()))
    arrays = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(pitch)).alias("pitches"))
    out = X.pitch_features(arrays)
    return r6(out.select(
        "l_orderkey", "pitch_count_pa", "avg_release_speed", "avg_spin_rate", "avg_induced_vertical_break", "avg_horizontal_movement", "fastball_share_pa", "breaking_share_pa", "offspeed_share_pa", "zone_rate_pa",
        "strikes_seen_pa", "last_release_speed", "last_pitch_type_code", "last_spin_rate", "last_strike_zone", "last_ivb", "last_hmov", "last_exit_velocity", "last_launch_angle", "last_is_barrel",
    ))


# --- candidates, holdouts, names ----------------------------------------------------------------------------------------

_RULES = C.RULES
_OFFERED = f"""{QUOTES}, lq AS (SELECT * FROM q WHERE snapshot_ts < commence_time QUALIFY row_number() OVER (PARTITION BY game_id, player_id, vendor, line_value ORDER BY snapshot_ts DESC NULLS LAST, {_TIES}) = 1),
 fair AS (SELECT *, CASE WHEN under_odds IS NOT NULL THEN {_OVER} / ({_OVER} + {_UNDER}) END AS f FROM lq),
 ln AS (SELECT game_id, player_id, line_value, avg(f) AS market, coalesce(stddev_samp(f), 0) AS std, count(DISTINCT vendor) AS vendor_count FROM fair GROUP BY ALL),
 ba AS (SELECT game_id, player_id, {M.BASE_UNCERTAINTY} + avg(std) AS base FROM ln GROUP BY ALL),
 j AS (SELECT * FROM fair JOIN ln USING (game_id, player_id, line_value) JOIN ba USING (game_id, player_id)),
 s AS (SELECT *, 'over' AS bet_side, over_odds AS odds, model_over_prob AS prob, market AS mp FROM j UNION ALL SELECT *, 'under', under_odds, 1 - model_over_prob, 1 - market FROM j WHERE under_odds IS NOT NULL),
 v AS (SELECT *, prob - coalesce(mp, 0) AS edge, {_EV.format(c=_CLIP.format('prob'), b=_PROFIT.format('odds'))} AS ev, base + std + coalesce(abs(prob - mp), {M.UNPRICED_GAP}) AS uncertainty FROM s)"""


@register("board_candidates", f"""{_OFFERED} SELECT {_CELL}, bet_side, odds, vendor_count, round(mp, 6) AS market_prob, round(edge, 6) + 0.0 AS edge, round(ev, 6) + 0.0 AS ev, round(uncertainty, 6) AS uncertainty, round(coalesce(abs(prob - mp), 0), 6) + 0.0::DOUBLE AS abs_gap, 0 AS is_live,
  round(edge, 9) >= {_RULES['edge']} AND round(ev, 9) >= {_RULES['ev']} AND round(uncertainty, 9) <= {_RULES['uncertainty']} AND vendor_count >= {_RULES['vendor_count']} AS pass_rules FROM v""")
def board_candidates(spark, d):
    """Both sides of every open quote with their uncertainty, and whether the rules take them."""
    rows = M.board_candidates(M.latest_quotes(M.pregame(quote_view(spark, d)), M.OFFER))
    # The rules compare rounded values: a mean's last bit depends on the order of its rows.
    compared = ("edge", "ev", "uncertainty")
    ruled = r6(rows.withColumn("own", F.struct(*compared, "market_prob", "abs_gap")), 9).withColumn("pass_rules", C.rule_filter())
    return r6(ruled.select(*_CELL_COLS, "bet_side", "odds", "vendor_count", "own.*", "is_live", "pass_rules"))


@register("guarded_holdout", f"""{EVALUATED}, g AS (SELECT game_id, player_id, max(snapshot_ts) AS latest FROM cand GROUP BY ALL), n AS (SELECT count(*) AS n, greatest({C.LEAST_HELD}, round_even(count(*) * 0.3::DOUBLE, 0)) AS held FROM g),
 h AS (SELECT game_id, player_id, row_number() OVER (ORDER BY latest, game_id, player_id) > n - CASE WHEN held < n THEN held ELSE greatest(1, n - 1) END AS is_eval FROM g, n) SELECT {_CELL}, is_eval FROM cand JOIN h USING (game_id, player_id)""")
def guarded_holdout(spark, d):
    return C.guarded_holdout(evaluated(spark, d), ["game_id", "player_id"], "snapshot_ts").select(*_CELL_COLS, "is_eval")


_ASKED = "CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN 'CUSTOMER ' || lpad(CAST(o_custkey AS {s}), 9, '0') ELSE 'CÚSTOMER.' || lpad(CAST(o_custkey AS {s}), 9, '0') || '!' END"


@register("player_match", f"""WITH k AS (SELECT trim(regexp_replace(regexp_replace(lower(strip_accents(c_name)), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) AS n, min(c_custkey) AS player_id FROM customer WHERE c_nationkey <> 3 GROUP BY ALL),
 a AS (SELECT o_orderkey, {_ASKED.format(s='VARCHAR')} AS player_name FROM orders)
 SELECT o_orderkey, player_name, player_id FROM a LEFT JOIN k ON k.n = trim(regexp_replace(regexp_replace(lower(strip_accents(player_name)), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))""")
def player_match(spark, d):
    """Names of orders, with other punctuation, accents and case, found among customers."""
    players = table(spark, d, "customer").where("c_nationkey <> 3").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("full_name"))
    asked = table(spark, d, "orders").select("o_orderkey", F.expr(_ASKED.format(s="STRING")).alias("player_name"))
    return MT.match_players(asked, players)
