"""Scans: single files, directories that may be missing, mixed snapshot folders, JSON archives, and sinks' counterparts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _D, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType()
QUOTE_SCHEMA = T.StructType([
    T.StructField(n, t) for n, t in (
        ("event_id", _S), ("game_id", _L), ("player_name", _S), ("player_id", _L), ("vendor", _S), ("prop_type", _S), ("line_value", _D), ("updated_at", _TS),
        ("commence_time", _TS), ("home_team", _S), ("away_team", _S), ("over_odds", _D), ("under_odds", _D), ("snapshot_ts", _TS), ("snapshot_date", T.DateType()), ("is_live_snapshot", T.IntegerType()),
    )
])
#: Nested quotes as vendors publish them.
RAW_SCHEMA = (
    "id string, commence_time string, home_team string, away_team string, bookmakers array<struct<key: string, title: string, last_update: string,"
    " markets: array<struct<key: string, last_update: string, outcomes: array<struct<name: string, description: string, participant: string, label: string, point: double, price: double>>>>>>"
)
#: yyyymmdd and hhmmss in a file's name, with any separators.
NAME_TIME = r"(\d{4})-?(\d{2})-?(\d{2})[T_ -]?(\d{2})[:-]?(\d{2})[:-]?(\d{2})"


def exists(spark: SparkSession, path: str) -> bool:
    """Through Spark's file systems, so that any store works."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or [])


def parquet_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.option("header", True).option("mode", "PERMISSIVE").schema(schema).csv(path)


def typed(df: DataFrame, schema: T.StructType = QUOTE_SCHEMA) -> DataFrame:
    """Exactly the schema's columns: try_cast, null where a column is missing."""
    def column(f: T.StructField) -> Column:
        if f.name not in df.columns:
            return F.lit(None).cast(f.dataType).alias(f.name)
        kind = df.schema[f.name].dataType
        if isinstance(kind, T.StringType) and isinstance(f.dataType, T.TimestampType):
            return F.try_to_timestamp(F.col(f.name)).alias(f.name)
        return F.col(f.name).try_cast(f.dataType).alias(f.name)

    return df.select(*map(column, schema))


def snapshot_union(spark: SparkSession, folders: Sequence[str], schema: T.StructType = QUOTE_SCHEMA) -> DataFrame:
    """Parquet and CSV snapshots of several folders by name, unreadable files skipped, times derived where missing."""
    parts = []
    for folder in folders:
        for kind, reader in (("parquet", spark.read.option("ignoreCorruptFiles", True).option("mergeSchema", True).parquet), ("csv", spark.read.option("header", True).csv)):
            pattern = f"{folder}/*.{kind}"
            if exists(spark, pattern):
                try:
                    parts.append(typed(reader(pattern), schema))
                except AnalysisException:
                    continue  # no file of this kind has a readable schema
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for part in parts[1:]:
        out = out.unionByName(part)
    ts = F.coalesce("snapshot_ts", "updated_at")
    live = F.coalesce(F.col("is_live_snapshot"), (ts >= F.col("commence_time")).cast("int"), F.lit(0))
    return out.withColumns({"snapshot_ts": ts, "snapshot_date": F.coalesce(F.col("snapshot_date"), F.to_date(ts)), "is_live_snapshot": live})


def name_time(name: Column) -> Column:
    """The time in a file's name; null if there is none."""
    parts = [F.regexp_extract(name, NAME_TIME, i) for i in range(1, 7)]
    return F.try_to_timestamp(F.concat_ws("", *parts), F.lit("yyyyMMddHHmmss"))


def json_archive(spark: SparkSession, path: str) -> DataFrame:
    """(fetched_at, raw struct): files hold one object or a list of them; what does not parse is left out."""
    files = spark.read.option("wholetext", True).text(path).select(F.col("value"), F.col("_metadata.file_name").alias("file"))
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<struct<{_nested(RAW_SCHEMA)}>>")).otherwise(F.array(F.from_json("value", RAW_SCHEMA)))
    return files.select(name_time(F.col("file")).alias("fetched_at"), F.explode(listed).alias("raw")).where("raw.id IS NOT NULL")


def _nested(ddl: str) -> str:
    return T.StructType.fromDDL(ddl).simpleString()[len("struct<") : -1]


def normalise_quotes(raw: DataFrame) -> DataFrame:
    """One row for each event, vendor, market, player and line of a table (fetched_at, raw), with both sides' odds.

    Outcomes are paired by name; of repeated outcomes the last wins. The player is the description, else the
    participant, else the label.
    """
    books = raw.select("fetched_at", F.col("raw.id").alias("event_id"), F.try_to_timestamp(F.col("raw.commence_time")).alias("commence_time"), "raw.home_team", "raw.away_team", F.explode("raw.bookmakers").alias("b"))
    markets = books.select("*", F.col("b.key").alias("vendor"), F.explode("b.markets").alias("m"))
    outcomes = markets.select("*", F.col("m.key").alias("prop_type"), F.try_to_timestamp(F.coalesce("m.last_update", "b.last_update")).alias("updated_at"), F.posexplode("m.outcomes").alias("at", "o"))
    rows = outcomes.select(
        "event_id", "commence_time", "home_team", "away_team", "vendor", "prop_type", "updated_at", "fetched_at", "at",
        F.coalesce("o.description", "o.participant", "o.label").alias("player_name"), F.lower("o.name").alias("side"), F.col("o.point").alias("line_value"), F.col("o.price").alias("price"),
    ).where("player_name IS NOT NULL AND line_value IS NOT NULL")
    price = lambda side: F.max_by("price", F.when(F.col("side") == side, F.col("at"))).alias(f"{side}_odds")
    keys = ["event_id", "commence_time", "home_team", "away_team", "vendor", "prop_type", "updated_at", "fetched_at", "player_name", "line_value"]
    return rows.groupBy(*keys).agg(price("over"), price("under"))


#: Rows of a props service: one market for each.
PROPS_SCHEMA = "game_id bigint, player_id bigint, vendor string, prop_type string, line_value double, updated_at string, market struct<type: string, over_odds: double, under_odds: double, odds: double>"


def market_quotes(rows: DataFrame, prop_type: str) -> DataFrame:
    """Flat quotes of rows in PROPS_SCHEMA: whole odds, cut towards zero, and `milestone_odds` for milestones alone.

    A missing vendor is an empty text, a missing line zero and a missing prop type the one asked for; rows without a game or
    a player are left out.
    """
    whole = lambda c: F.col(f"market.{c}").cast("bigint")
    return rows.where("game_id IS NOT NULL AND player_id IS NOT NULL").select(
        "game_id", "player_id", F.coalesce("vendor", F.lit("")).alias("vendor"), F.coalesce("prop_type", F.lit(prop_type)).alias("prop_type"), F.coalesce("line_value", F.lit(0.0)).alias("line_value"),
        whole("over_odds").alias("over_odds"), whole("under_odds").alias("under_odds"), F.when(F.col("market.type") == "milestone", whole("odds")).alias("milestone_odds"), "updated_at",
    )
