"""Registered queries of sinks and scans that read back what they wrote, of normalisers and of distribution folds.

What the first of them write goes to a folder of its own in the session's shared folder and stays there, as their
results read it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import odds as O
from ..functions import pmf as PMF
from ..functions import text as TX
from ..operators.lineage import shared_folder
from ..sources import scans as SC
from ..sources import sinks as SK
from .catalogue import _LOGITS, logits_pmf, r6, register
from .views import QUOTE_SQL, quote_view, table


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4()}"


# --- sinks and scans --------------------------------------------------------------------------------------------------

_DUCK_QUOTES = QUOTE_SQL.replace("AS STRING", "AS VARCHAR")


@register("snapshot_folders", f"""WITH q AS ({_DUCK_QUOTES})
 SELECT l_orderkey::VARCHAR AS event_id, player_id, vendor, line_value, over_odds::DOUBLE AS over_odds, CASE WHEN l_linenumber <= 3 THEN under_odds::DOUBLE END AS under_odds,
  CAST(snapshot_ts AS DATE) AS snapshot_date, CASE WHEN l_linenumber <= 3 THEN 2 WHEN commence_time IS NULL THEN 0 ELSE (snapshot_ts >= commence_time)::INTEGER END AS is_live_snapshot FROM q""")
def snapshot_folders(spark, d):
    """Quotes written as parquet and CSV snapshots with different columns, and read as one table."""
    folder = _folder(spark, "snapshots")
    q = quote_view(spark, d).withColumns({"event_id": F.col("l_orderkey").cast("string"), "snapshot_ts": F.col("snapshot_ts").cast("timestamp"), "commence_time": F.col("commence_time").cast("timestamp")})
    shared = ["event_id", "player_id", "vendor", "line_value", "over_odds"]
    SK.write_parquet(q.where("l_linenumber <= 3").select(*shared, "under_odds", "snapshot_ts", F.lit(2).alias("is_live_snapshot")), f"{folder}/parquet")
    SK.write_csv(q.where("l_linenumber > 3").select(*shared, F.col("snapshot_ts").alias("updated_at"), "commence_time"), f"{folder}/csv")
    found = SC.snapshot_union(spark, [f"{folder}/parquet", f"{folder}/csv", f"{folder}/missing"])
    return found.select(*shared, "under_odds", "snapshot_date", "is_live_snapshot")


@register("csv_orders", "SELECT o_orderkey, o_orderpriority, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders")
def csv_orders(spark, d):
    """Orders written as CSV with a header and read by their schema."""
    path = f"{_folder(spark, 'csv')}/orders"
    SK.write_csv(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", F.to_date("o_orderdate").alias("o_orderdate")), path)
    return SC.csv(spark, path, T.StructType.fromDDL("o_orderkey bigint, o_orderpriority string, o_totalprice double, o_orderdate date"))


@register("resolved_sides", """SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'unresolved' ELSE 'resolved' END AS side, c_nationkey
 FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON o_custkey = c_custkey""")
def resolved_sides(spark, d):
    """Orders of known customers and of others, each from the folder that the sink put them in; a folder never written is empty."""
    path = _folder(spark, "resolved")
    known = table(spark, d, "customer").where("c_custkey % 3 <> 0").select("c_custkey", "c_nationkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    SK.write_resolved(o.join(known, F.col("o_custkey") == F.col("c_custkey"), "left"), "c_custkey", path)
    schema = T.StructType.fromDDL("o_orderkey bigint, c_nationkey bigint")
    read = [SC.parquet_or_empty(spark, f"{path}/{side}", schema).withColumn("side", F.lit(side)) for side in ("resolved", "unresolved", "missing")]
    return read[0].unionByName(read[1]).unionByName(read[2])


@register("coerced_numbers", """WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN '' ELSE round(value, 2)::VARCHAR END AS v, CASE WHEN event_id % 7 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS said FROM events)
 SELECT event_id, try_cast(v AS DOUBLE) AS amount, strftime(try_cast(said AS TIMESTAMP), '%Y-%m-%d %H') AS hour, NULL::BIGINT AS absent FROM t""")
def coerced_numbers(spark, d):
    """Texts as numbers and times, null where they are neither, and a column that the table lacks."""
    kind = F.col("event_id") % 5
    e = table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("event_id"), F.when(kind == 0, "n/a").when(kind == 1, "").otherwise(F.round("value", 2).cast("string")).alias("amount"),
        F.when(F.col("event_id") % 7 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("hour"),
    )
    typed = SC.typed(e, T.StructType.fromDDL("event_id bigint, amount double, hour timestamp, absent bigint"))
    return typed.withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH"))


# --- normalisers ------------------------------------------------------------------------------------------------------

_RESULTS = ("Strikeout Swinging", "Intentional Walk", "walk", "Grounded into Double Play", "HOME RUN", "Double", "Groundout", "Hit by pitch")
_RESULT_SQL = "CASE event_id % 9 " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(_RESULTS)) + " END"


@register("result_flags", f"""WITH t AS (SELECT event_id, lower(coalesce({_RESULT_SQL} || ' ' || event_type, '')) AS r FROM events)
 SELECT event_id, contains(r, 'strikeout')::INTEGER AS is_strikeout, (contains(r, 'walk') AND NOT contains(r, 'intentional'))::INTEGER AS is_walk,
  (regexp_matches(r, 'single|double|triple|home run') AND NOT contains(r, 'double play'))::INTEGER AS is_hit, contains(r, 'out')::INTEGER AS is_out FROM t""")
def result_flags(spark, d):
    result = F.concat(F.expr(_RESULT_SQL), F.lit(" "), F.col("event_type"))
    return table(spark, d, "events").select("event_id", *(c.alias(n) for n, c in TX.result_flags(result).items()))


_SIDES = ("o", " OV", "Under", "un ", "U", "over", "both", "")
_SIDE_SQL = "CASE l_orderkey % 9 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_SIDES)) + " END"
_KEYS = ("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")


@register("sides_normalised", f"""WITH t AS (SELECT {", ".join(_KEYS)}, lower(trim({_SIDE_SQL})) AS s, nullif(upper(substr(trim(CASE WHEN l_linenumber = 2 THEN '  ' ELSE ' ' || l_returnflag || 'ight' END), 1, 1)), '') AS hand FROM lineitem)
 SELECT {", ".join(_KEYS)}, CASE WHEN s IN ('over', 'o', 'ov') THEN 'over' WHEN s IN ('under', 'u', 'un') THEN 'under' END AS side, hand FROM t""")
def sides_normalised(spark, d):
    hand = F.when(F.col("l_linenumber") == 2, "  ").otherwise(F.concat(F.lit(" "), F.lower("l_returnflag"), F.lit("ight")))
    return table(spark, d, "lineitem").select(*_KEYS, TX.side(F.expr(_SIDE_SQL)).alias("side"), TX.hand(hand).alias("hand"))


_CUSTOMER = "CASE c_custkey % 4 WHEN 0 THEN 'José  O''Neil-' WHEN 1 THEN 'Åsa & ' WHEN 2 THEN '  D. ' ELSE '' END || c_name || CASE WHEN c_custkey % 3 = 0 THEN ' Jr.' ELSE '' END"


@register("quote_names", f"""SELECT c_custkey, trim(regexp_replace(regexp_replace(lower(strip_accents({_CUSTOMER})), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) AS name,
 trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(strip_accents({_CUSTOMER})), '&', ' and '), '[^a-z0-9]+', ' ', 'g'), '\\b(jr|sr|ii|iii|iv)\\b', ' ', 'g'), ' +', ' ', 'g')) AS registry_name FROM customer""")
def quote_names(spark, d):
    """Both normalisers of names, which treat punctuation differently."""
    name = F.expr(_CUSTOMER.replace("O''Neil", "O\\'Neil"))
    return table(spark, d, "customer").select("c_custkey", TX.quote_name(name).alias("name"), TX.registry_name(name).alias("registry_name"))


@register("finite_values", """WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Infinity'::DOUBLE WHEN 1 THEN '-Infinity'::DOUBLE WHEN 2 THEN 'NaN'::DOUBLE ELSE round(value, 2) END AS v FROM events)
 SELECT event_id, CASE WHEN isfinite(v) THEN v END AS v FROM t""")
def finite_values(spark, d):
    kind = F.col("event_id") % 5
    odd = F.when(kind == 0, float("inf")).when(kind == 1, float("-inf")).when(kind == 2, float("nan")).otherwise(F.round("value", 2))
    return table(spark, d, "events").select("event_id", O.clean(odd).alias("v"))


# --- folds of distributions -------------------------------------------------------------------------------------------


@register("pmf_from_cdf", _LOGITS + """, c AS (SELECT vec_id, unnest(pmf) AS p, unnest(range(0, 12)) AS k FROM f),
 s AS (SELECT vec_id, k, sum(p) OVER (PARTITION BY vec_id ORDER BY k) + ((vec_id + k) % 3 - 1) / 20.0::DOUBLE AS x FROM c),
 m AS (SELECT vec_id, k, max(CASE WHEN k = 11 THEN 1.0::DOUBLE ELSE least(greatest(x, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) END) OVER (PARTITION BY vec_id ORDER BY k) AS x FROM s),
 w AS (SELECT vec_id, k, greatest(x - coalesce(lag(x) OVER (PARTITION BY vec_id ORDER BY k), 0), 0) AS w FROM m)
 SELECT vec_id, CAST(k AS INTEGER) AS k, round(w / sum(w) OVER (PARTITION BY vec_id), 6) AS p FROM w""")
def pmf_from_cdf(spark, d):
    """Cumulative curves that wobble, clipped, made rising and turned into cells."""
    wobble = lambda x, i: x + (F.pmod(F.col("vec_id") + i, F.lit(3)) - 1) / 20.0
    q = logits_pmf(spark, d).select("vec_id", PMF.calibrated_from_cdf(F.transform(PMF.cdf(F.col("pmf")), wobble)).alias("q"))
    return r6(q.select("vec_id", F.posexplode("q").alias("k", "p")))


@register("pmf_length_mixture", _LOGITS.replace("WITH x", "WITH RECURSIVE x") + """, g AS (
  SELECT vec_id, 0 AS i, probs, [CASE WHEN j = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FOR j IN range(0, 8)] AS run, 1.0::DOUBLE AS alive, [0.0::DOUBLE FOR j IN range(0, 8)] AS acc FROM f UNION ALL
  SELECT vec_id, i, probs, run, alive * (1 - h), [acc[j] + run[j] * CASE WHEN i = 12 THEN alive ELSE alive * h END FOR j IN range(1, 9)] FROM (
   SELECT vec_id, i + 1 AS i, probs, alive, acc, 0.04::DOUBLE * (i + 1) + 0.01::DOUBLE * (vec_id % 5) AS h,
    [run[j] * (1 - probs[i + 1]) + coalesce(run[j - 1], 0) * probs[i + 1] + CASE WHEN j = 8 THEN run[j] * probs[i + 1] ELSE 0 END FOR j IN range(1, 9)] AS run FROM g WHERE i < 12))
 SELECT vec_id, CAST(unnest(range(0, 8)) AS INTEGER) AS k, round(unnest([v / list_sum(acc) FOR v IN acc]), 6) AS p FROM g WHERE i = 12""")
def pmf_length_mixture(spark, d):
    """Counts over sessions whose length is uncertain: twelve steps with a chance to end at each."""
    base = logits_pmf(spark, d)
    hazards = F.transform("probs", lambda x, i: 0.04 * (i + 1) + 0.01 * (F.col("vec_id") % 5))
    q = base.select("vec_id", PMF.mixture(F.col("probs"), PMF.lengths(hazards), 8).alias("q"))
    return r6(q.select("vec_id", F.posexplode("q").alias("k", "p")))
