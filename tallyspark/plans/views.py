"""The driver's tables in the roles of event log and quotes (stand-ins: they carry no domain meaning)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PA_SQL = """WITH e AS (
 SELECT event_id, ts, user_id, event_type, value,
        CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
        CAST(FLOOR((EXTRACT(DAY FROM ts) - 1) / 7) AS INT) AS wk
 FROM events)
SELECT CAST(wk * 1000 + user_id % 50 AS BIGINT)            AS game_id,
       wk                                                  AS game_week,
       user_id                                             AS pitcher_id,
       k                                                   AS batter_id,
       CAST(ROW_NUMBER() OVER (PARTITION BY wk, user_id % 50 ORDER BY ts, event_id) AS BIGINT) AS pa_number,
       CASE WHEN user_id % 2 = 0 THEN 'top' ELSE 'bottom' END AS half_inning,
       CASE WHEN k % 2 = 0 THEN 'L' ELSE 'R' END           AS batter_side,
       CASE WHEN user_id % 3 = 0 THEN 'L' ELSE 'R' END     AS pitcher_hand,
       CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS is_strikeout,
       CASE WHEN event_type = 'signup'   THEN 1 ELSE 0 END AS is_walk,
       CASE WHEN event_type = 'click'    THEN 1 ELSE 0 END AS is_hit,
       CASE WHEN event_type IN ('purchase','view','error') THEN 1 ELSE 0 END AS is_out,
       1 + event_id % 7                                    AS pitch_count_pa,
       CASE WHEN event_id % 11 <> 0 THEN value END         AS avg_release_speed,
       ts, event_id
FROM e"""

QUOTE_SQL = """WITH b AS (
 SELECT l.*, o.o_orderdate,
        CAST(ROUND(l_discount * 100) AS INT) AS d, CAST(ROUND(l_tax * 100) AS INT) AS t
 FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)
SELECT CAST(l_partkey % 40 AS BIGINT)                      AS game_id,
       l_partkey                                           AS player_id,
       CONCAT('v', CAST(l_suppkey % 8 AS STRING))          AS vendor,
       CASE WHEN l_linenumber % 2 = 1 THEN 'primary' ELSE 'alternate' END AS prop_type,
       CAST(3.0 + CAST(l_quantity AS INT) % 4 + CASE WHEN l_orderkey % 10 = 0 THEN 0.0 ELSE 0.5 END AS DOUBLE) AS line_value,
       CASE WHEN d < 5 THEN -(105 + 10 * d) ELSE 100 + 5 * d END AS over_odds,
       CASE WHEN l_linenumber = 7 THEN NULL
            WHEN t < 5 THEN -(105 + 8 * t) ELSE 100 + 6 * t END  AS under_odds,
       l_shipdate AS snapshot_ts, o_orderdate AS commence_time,
       CAST((l_partkey * 7) % 11 AS INT)                   AS actual_total_k,
       (1 + CAST(ROUND(l_extendedprice * 100) AS BIGINT) % 98) / 100.0E0 AS model_over_prob,
       l_orderkey, l_linenumber, l_suppkey
FROM b"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pa_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PA_SQL.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


def quote_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = QUOTE_SQL.replace("FROM lineitem l JOIN orders o", "FROM {lineitem} l JOIN {orders} o")
    return spark.sql(sql, lineitem=table(spark, sf_dir, "lineitem"), orders=table(spark, sf_dir, "orders"))
