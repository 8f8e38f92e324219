"""Frames of a board: which rows count at a time, who is active, what the next ones meet, and small reshapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .features import latest_row


def as_of(df: DataFrame, day: str, cutoff: Column) -> DataFrame:
    """The rows before the cutoff; a missing day is not before it."""
    return df.where(F.col(day) < cutoff)


def without_status(df: DataFrame, status: str, excluded: Sequence[str]) -> DataFrame:
    """Rows whose status, in any case, is none of the excluded; a missing status stays."""
    return df.where(~F.coalesce(F.lower(F.trim(status)).isin(*(s.lower() for s in excluded)), F.lit(False)))


def active(events: DataFrame, keys: Sequence[str], entity: str, order: Sequence[str]) -> DataFrame:
    """(keys, entity): who is in each key's last row."""
    return latest_row(events.where(F.col(entity).isNotNull()), keys, [F.col(c).desc() for c in order]).select(*keys, entity)


def future_lineup(lineups: DataFrame, latest_batters: DataFrame, latest_pitcher: DataFrame, batter: str = "batter_id") -> DataFrame:
    """One row for each place of each line-up (array column `lineup`), with the latest row of its batter, missing if he
    has none, and the one latest row of the pitcher on all of them."""
    places = lineups.select(*(c for c in lineups.columns if c != "lineup"), F.posexplode("lineup").alias("pos", batter)).withColumn("place", F.col("pos") + 1).drop("pos")
    return places.join(latest_batters, batter, "left").crossJoin(F.broadcast(latest_pitcher.limit(1)))


def state_by_id_or_name(entries: DataFrame, states: DataFrame, id_: str, name: str, columns: Sequence[str]) -> DataFrame:
    """Entries with the state of their id, or else of their name; of states with one name that with the smallest id counts."""
    by_id = states.select(F.col(id_).alias("_id"), F.struct(*columns).alias("_by_id"))
    by_name = states.groupBy(F.col(name).alias("_name")).agg(F.min_by(F.struct(*columns), F.col(id_)).alias("_by_name"))
    met = entries.join(by_id, F.col(id_) == F.col("_id"), "left").join(by_name, F.col(name) == F.col("_name"), "left")
    found = F.coalesce("_by_id", "_by_name")
    source = F.when(F.col("_by_id").isNotNull(), "id").when(F.col("_by_name").isNotNull(), "name")
    return met.select(*entries.columns, *(found[c].alias(c) for c in columns), source.alias("matched_by"))


def prefixed(df: DataFrame, prefix: str, keys: Sequence[str]) -> DataFrame:
    """All columns but the keys get the prefix, unless they have it."""
    return df.select(*keys, *(F.col(f"`{c}`").alias(c if c.startswith(prefix) else prefix + c) for c in df.columns if c not in keys))


def numeric_means(df: DataFrame, keys: Sequence[str], prefix: str = "") -> DataFrame:
    """The mean of every numeric column for each key."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in keys]
    return prefixed(df.groupBy(*keys).agg(*(F.avg(F.col(f"`{c}`")).alias(c) for c in numeric)), prefix, keys)


def full_name(known: Sequence[str], first: str, last: str) -> Column:
    """The first non-empty of the known names, or else first and last name joined; null if all are empty."""
    filled = lambda c: F.when(F.trim(c) != "", F.trim(c))
    joined = F.trim(F.concat_ws(" ", filled(F.col(first)), filled(F.col(last))))
    return F.coalesce(*(filled(F.col(c)) for c in known), F.when(joined != "", joined))


def matchup(events: DataFrame) -> DataFrame:
    """Adds same_hand, runners_on and scoring_position; a missing side or runner counts as none."""
    on = [F.coalesce(F.col(f"runner_on_{b}").cast("int"), F.lit(0)) for b in ("first", "second", "third")]
    return events.withColumns({
        "same_hand": F.coalesce(F.col("batter_side") == F.col("pitcher_hand"), F.lit(False)).cast("int"),
        "runners_on": on[0] + on[1] + on[2], "scoring_position": ((on[1] + on[2]) > 0).cast("int"),
    })


def local_day(ts: str, zone: str) -> Column:
    """The calendar day in a time zone of a UTC timestamp."""
    return F.to_date(F.from_utc_timestamp(F.col(ts), zone))


def minutes(start: Column, end: Column, step: int) -> Column:
    """All times from start to end, `step` minutes apart, as an array."""
    return F.sequence(start, end, F.expr(f"INTERVAL {int(step)} MINUTES"))


def chunks(values: DataFrame, column: str, size: int) -> DataFrame:
    """(chunk, values): the distinct values in order, `size` to a chunk. For request lists: one row a value, not an event."""
    place = F.row_number().over(Window.orderBy(column)) - 1
    numbered = values.select(column).where(F.col(column).isNotNull()).distinct().withColumn("chunk", F.floor(place / size).cast("int"))
    return numbered.groupBy("chunk").agg(F.array_sort(F.collect_list(column)).alias("values"))


def set_apart(records: DataFrame, raw: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(parsed, unparsable) of a column of JSON texts: `parsed` has the fields of the schema, `unparsable` the raw texts."""
    fields = T.StructType.fromDDL(schema)
    whole = T.StructType([*fields.fields, T.StructField("_corrupt_record", T.StringType())])
    read = records.withColumn("_parsed", F.from_json(raw, whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col(raw).isNull() | F.col("_parsed._corrupt_record").isNotNull()
    return read.where(~bad).select(*(c for c in records.columns if c != raw), *(F.col(f"_parsed.{f.name}").alias(f.name) for f in fields)), read.where(bad).select(*records.columns)
