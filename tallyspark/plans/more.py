"""Registered queries of the board's frames, splits and small reshapes, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import frames as FR
from ..operators import market as M
from ..operators import metrics as S
from ..operators import splits as SP
from .catalogue import EVALUATED, PA, SCORED, evaluated, r6, register, scored
from .views import pa_view, table


@register("as_of_events", "SELECT event_id, user_id FROM events WHERE CAST(ts AS DATE) < (SELECT max(CAST(ts AS DATE)) - 7 FROM events)")
def as_of_events(spark, d):
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    last = e.agg(F.max("day")).first()[0]
    return FR.as_of(e, "day", F.date_sub(F.lit(last), 7)).select("event_id", "user_id")


@register("status_exclusion", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IS NULL OR lower(trim(o_orderstatus)) NOT IN ('f', 'p')")
def status_exclusion(spark, d):
    return FR.without_status(table(spark, d, "orders"), "o_orderstatus", ["F", "P"]).select("o_orderkey", "o_orderstatus")


@register("active_pitcher", f"{PA} SELECT game_id, half_inning, arg_max(pitcher_id, (pa_number, event_id)) AS pitcher_id FROM pa GROUP BY game_id, half_inning")
def active_pitcher(spark, d):
    return FR.active(pa_view(spark, d), ["game_id", "half_inning"], "pitcher_id", ["pa_number", "event_id"])


@register("future_lineup", f"""{PA}, f AS (SELECT game_id, pitcher_id, batter_id, min(pa_number) AS p FROM pa WHERE batter_id IS NOT NULL GROUP BY ALL),
 l AS (SELECT game_id, pitcher_id, batter_id, row_number() OVER (PARTITION BY game_id, pitcher_id ORDER BY p, batter_id)::INTEGER AS place FROM f),
 b AS (SELECT batter_id, avg_release_speed AS batter_speed FROM pa WHERE batter_id % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY batter_id ORDER BY ts DESC, event_id DESC) = 1),
 c AS (SELECT pitcher_id AS latest_pitcher, avg_release_speed AS pitcher_speed FROM pa ORDER BY ts DESC, event_id DESC LIMIT 1)
 SELECT game_id, pitcher_id, batter_id, place, round(batter_speed, 6) AS batter_speed, latest_pitcher, round(pitcher_speed, 6) AS pitcher_speed FROM l LEFT JOIN b USING (batter_id), c""")
def future_lineup(spark, d):
    pa = pa_view(spark, d)
    newest = [F.col("ts").desc(), F.col("event_id").desc()]
    batters = X.latest_row(pa.where("batter_id % 7 <> 0"), ["batter_id"], newest).select("batter_id", F.col("avg_release_speed").alias("batter_speed"))
    pitcher = pa.orderBy(*newest).limit(1).select(F.col("pitcher_id").alias("latest_pitcher"), F.col("avg_release_speed").alias("pitcher_speed"))
    out = FR.future_lineup(X.lineup_order(pa, ["game_id", "pitcher_id"], "batter_id"), batters, pitcher)
    return r6(out.select("game_id", "pitcher_id", "batter_id", "place", "batter_speed", "latest_pitcher", "pitcher_speed"))


@register("state_by_id_or_name", """WITH e AS (SELECT c_custkey AS entry, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey END AS id, 'n' || (c_custkey // 2) AS name FROM customer),
 s AS (SELECT o_custkey AS id, 'n' || (o_custkey // 2) AS name, count(*) AS orders, round(max(o_totalprice), 2) AS largest FROM orders GROUP BY o_custkey),
 n AS (SELECT name, arg_min(orders, id) AS orders, arg_min(largest, id) AS largest FROM s GROUP BY name)
 SELECT entry, coalesce(s.orders, n.orders) AS orders, coalesce(s.largest, n.largest) AS largest, CASE WHEN s.id IS NOT NULL THEN 'id' WHEN n.name IS NOT NULL THEN 'name' END AS matched_by
 FROM e LEFT JOIN s ON e.id = s.id LEFT JOIN n ON e.name = n.name""")
def state_by_id_or_name(spark, d):
    name = lambda c: F.concat(F.lit("n"), F.floor(F.col(c) / 2).cast("string"))
    entries = table(spark, d, "customer").select(F.col("c_custkey").alias("entry"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey")).alias("id"), name("c_custkey").alias("name"))
    states = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.round(F.max("o_totalprice"), 2).alias("largest")).select(F.col("o_custkey").alias("id"), name("o_custkey").alias("name"), "orders", "largest")
    return FR.state_by_id_or_name(entries, states, "id", "name", ["orders", "largest"]).select("entry", "orders", "largest", "matched_by")


@register("unresolved_rows", "SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 20 = 0 AND o_custkey IS NOT NULL)")
def unresolved_rows(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_orderkey % 20 = 0")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey", "c_nationkey")


@register("numeric_means", "SELECT l_returnflag, round(avg(l_quantity), 6) AS ext_l_quantity, round(avg(l_discount), 6) AS ext_l_discount, round(avg(l_linenumber), 6) AS ext_l_linenumber FROM lineitem GROUP BY l_returnflag")
def numeric_means(spark, d):
    l = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_discount", "l_linenumber", "l_shipdate")
    return r6(FR.numeric_means(l, ["l_returnflag"], "ext_"))


@register("name_fallback", """SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN nullif(trim(c_name), '') END, nullif(trim(concat_ws(' ', CASE WHEN c_custkey % 5 <> 0 THEN trim(c_mktsegment) END, CASE WHEN c_custkey % 7 <> 0 THEN c_nationkey::VARCHAR END)), '')) AS name FROM customer""")
def name_fallback(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("full"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("first"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey").cast("string")).alias("last"))
    return c.select("c_custkey", FR.full_name(["full"], "first", "last").alias("name"))


@register("matchup_features", f"""{PA} SELECT event_id, CASE WHEN batter_side = pitcher_hand THEN 1 ELSE 0 END AS same_hand,
 (event_id % 2 = 0)::INTEGER + (event_id % 3 = 0)::INTEGER + coalesce(CASE WHEN event_id % 11 <> 0 THEN event_id % 5 = 0 END, false)::INTEGER AS runners_on,
 (event_id % 3 = 0 OR (event_id % 11 <> 0 AND event_id % 5 = 0))::INTEGER AS scoring_position FROM pa""")
def matchup_features(spark, d):
    third = F.when(F.col("event_id") % 11 != 0, F.col("event_id") % 5 == 0)
    pa = pa_view(spark, d).withColumns({"runner_on_first": F.col("event_id") % 2 == 0, "runner_on_second": F.col("event_id") % 3 == 0, "runner_on_third": third})
    return FR.matchup(pa).select("event_id", "same_hand", "runners_on", "scoring_position")


@register("local_day", "SELECT event_id, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS day FROM events")
def local_day(spark, d):
    return table(spark, d, "events").select("event_id", FR.local_day("ts", "America/New_York").alias("day"))


@register("minute_range", "SELECT unnest(generate_series(a, a + INTERVAL 2 DAY, INTERVAL 90 MINUTE)) AS at FROM (SELECT min(CAST(CAST(ts AS DATE) AS TIMESTAMP)) AS a FROM events)")
def minute_range(spark, d):
    start = table(spark, d, "events").agg(F.min(F.to_date("ts")).cast("timestamp_ntz").alias("a"))
    return start.select(F.explode(FR.minutes(F.col("a"), F.col("a") + F.expr("INTERVAL 2 DAYS"), 90)).alias("at"))


@register("chunk_lists", """WITH v AS (SELECT DISTINCT c_nationkey AS k FROM customer), n AS (SELECT k, ((row_number() OVER (ORDER BY k) - 1) // 4)::INTEGER AS chunk FROM v)
 SELECT chunk, string_agg(k::VARCHAR, ',' ORDER BY k) AS keys FROM n GROUP BY chunk""")
def chunk_lists(spark, d):
    out = FR.chunks(table(spark, d, "customer"), "c_nationkey", 4)
    return out.select("chunk", F.array_join("values", ",").alias("keys"))


@register("set_apart", "SELECT event_id, try_cast(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, event_id % 9 = 0 AS unparsable FROM events WHERE event_id % 9 <> 0 UNION ALL SELECT event_id, NULL, true FROM events WHERE event_id % 9 = 0")
def set_apart(spark, d):
    e = table(spark, d, "events")
    text = F.when(F.col("event_id") % 9 == 0, F.lit('{"k": ')).otherwise(F.concat(F.lit('{"k": '), F.regexp_extract("props", "([0-9]+)", 1), F.lit("}")))
    good, bad = FR.set_apart(e.select("event_id", text.alias("raw")), "raw", "k bigint")
    return good.select("event_id", "k", F.lit(False).alias("unparsable")).unionByName(bad.select("event_id", F.lit(None).cast("long").alias("k"), F.lit(True).alias("unparsable")))


@register("three_way_split", """WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), r AS (SELECT day, row_number() OVER (ORDER BY day) AS place, count(*) OVER () AS n FROM d),
 p AS (SELECT day, CASE WHEN place > n - greatest(7, round_even(n * 0.1, 0)) THEN 'evaluate' WHEN place > n - 2 * greatest(7, round_even(n * 0.1, 0)) THEN 'calibrate' ELSE 'train' END AS part FROM r)
 SELECT part, count(*) AS n, min(CAST(ts AS DATE)) AS first_day, max(CAST(ts AS DATE)) AS last_day FROM events JOIN p ON CAST(ts AS DATE) = day GROUP BY part""")
def three_way_split(spark, d):
    out = SP.out_of_time(table(spark, d, "events"), F.to_date("ts"))
    return out.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min(F.to_date("ts")).alias("first_day"), F.max(F.to_date("ts")).alias("last_day"))


@register("tail_split", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) > greatest(200, (SELECT count(*) FROM orders) // 5) AS is_train FROM orders")
def tail_split(spark, d):
    return SP.tail_split(table(spark, d, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "is_train")


_QS = ", ".join(f"{i}/15.0::DOUBLE" for i in range(16))


@register("ece_digitised", f"""{SCORED}, e AS (SELECT quantile_cont(p, [{_QS}]) AS qs FROM t),
 u AS (SELECT list_sort(list_distinct(qs)) AS edges FROM e), i AS (SELECT edges[2:len(edges) - 1] AS inner_edges FROM u),
 b AS (SELECT p, y, (SELECT count(*) FROM unnest(inner_edges) v(x) WHERE x < p) AS bin FROM t, i),
 g AS (SELECT count(*) AS n, avg(p) AS mp, avg(y) AS my FROM b GROUP BY bin) SELECT round(sum(n * abs(my - mp)) / sum(n), 6) AS ece FROM g""")
def ece_digitised(spark, d):
    return r6(SP.digitised_error(scored(spark, d)))


@register("summary_quote", f"""{EVALUATED} SELECT game_id, player_id, vendor, line_value, round(market_over_prob, 9) AS market_over_prob FROM cand
 QUALIFY row_number() OVER (PARTITION BY game_id, player_id ORDER BY abs(market_over_prob - 0.5), snapshot_ts, line_value, vendor, l_orderkey, l_linenumber, l_suppkey) = 1""")
def summary_quote(spark, d):
    order = [F.abs(F.col("market_over_prob") - 0.5).asc(), *(F.col(c).asc() for c in ("snapshot_ts", "line_value", "vendor", *M.TIES))]
    return r6(X.latest_row(evaluated(spark, d), ["game_id", "player_id"], order).select("game_id", "player_id", "vendor", "line_value", "market_over_prob"), 9)


_FEATURES = ("l_quantity", "l_discount", "l_tax")
_RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0E0"


@register("spearman_by_magnitude", f"""WITH t AS (SELECT l_quantity, l_discount, l_tax, l_extendedprice AS y FROM lineitem), r AS (SELECT {", ".join(f"{_RANK.format(c)} AS {c}" for c in (*_FEATURES, "y"))} FROM t),
 s AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr({c}, y), 6) AS spearman FROM r" for c in _FEATURES)})
 SELECT feature, spearman, row_number() OVER (ORDER BY abs(spearman) DESC, feature)::INTEGER AS place FROM s""")
def spearman_by_magnitude(spark, d):
    rows = table(spark, d, "lineitem").select(*_FEATURES, "l_extendedprice")
    out = None
    for c in _FEATURES:  # one row each
        one = S.spearman(rows, c, "l_extendedprice").select(F.lit(c).alias("feature"), F.round("spearman", 6).alias("spearman"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.abs(F.col("spearman")).desc(), "feature")))
