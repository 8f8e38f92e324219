"""Features of an event log, each from rows before the one it describes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settled
from .metrics import exact_quantiles

ORDER = ("ts", "event_id")
WINDOWS = (15, 30, 60)
SUMS = ("is_strikeout", "is_walk", "is_hit", "is_out", "pitch_count_pa")
WORKLOAD_PITCHES, WORKLOAD_TIMES = 85, 2


def least_observations(n: int) -> int:
    return max(5, n // 4)


def rolling_rates(events: DataFrame, entity: str, measures: Sequence[str], windows: Sequence[int] = WINDOWS, order: Sequence[str] = ORDER) -> DataFrame:
    """Adds <entity>_<measure>_<n>: the mean of the previous n rows' non-null values, null under least_observations(n)."""
    w = Window.partitionBy(entity).orderBy(*order)
    added = {}
    for n in windows:
        before = w.rowsBetween(-n, -1)
        for m in measures:
            added[f"{entity}_{m}_{n}"] = F.when(F.count(m).over(before) >= least_observations(n), F.avg(m).over(before))
    return events.withColumns(added)


def state_so_far(events: DataFrame, keys: Sequence[str] = ("game_id", "pitcher_id"), order: Sequence[str] = ("pa_number", "event_id")) -> DataFrame:
    """Adds bf_so_far, the running sums before each row, and what follows from them."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    bf = (F.row_number().over(w) - 1).alias("bf_so_far")
    sums = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_so_far") for c in SUMS]
    met = Window.partitionBy(*keys, "batter_id").orderBy(*order)
    out = events.select("*", bf, *sums, (F.row_number().over(met) - 1).alias("faced_before"))
    return _derived(out)


def _derived(out: DataFrame) -> DataFrame:
    times = F.floor(F.col("bf_so_far") / 9).cast("long")
    return out.withColumns({
        "times_through": times,
        "pitches_per_bf": F.when(F.col("bf_so_far") > 0, F.col("pitch_count_pa_so_far") / F.col("bf_so_far")),
        "heavy_workload": ((F.col("pitch_count_pa_so_far") >= WORKLOAD_PITCHES) | (times >= WORKLOAD_TIMES)).cast("int"),
    })


def state_so_far_compat(events: DataFrame, keys: Sequence[str] = ("game_id", "pitcher_id"), order: Sequence[str] = ("pa_number", "event_id")) -> DataFrame:
    """As state_so_far, but a group's first row inherits the sums of the group before it in key order.

    Groups are dealt into ranges of their keys, written out so that both readers find the same ones; the first group of a
    range is handed the last one of the range before, so no task orders all groups.
    """
    right = state_so_far(events, keys, order)
    sums = [f"{c}_total" for c in SUMS]
    totals = events.groupBy(*keys).agg(*(F.sum(c).alias(f"{c}_total") for c in SUMS))
    ranges = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settled(totals.repartitionByRange(ranges, *keys).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range").orderBy(*keys)
    lasts = ranged.groupBy("_range").agg(F.max_by(F.struct(*sums), F.struct(*keys)).alias("_last"))
    before = lasts.select("_range", F.lag("_last").over(Window.orderBy("_range")).alias("_before"))  # one row a range
    placed = ranged.select("*", F.row_number().over(inside).alias("_place"), F.lag(F.struct(*sums)).over(inside).alias("_inside")).join(before, "_range")
    group = F.when(F.col("_place") == 1, F.col("_before")).otherwise(F.col("_inside"))
    handed = placed.select(*keys, group.alias("_group")).select(*keys, *(F.coalesce(F.col(f"_group.{c}_total"), F.lit(0)).alias(f"{c}_handed") for c in SUMS))
    first = F.col("bf_so_far") == 0
    joined = right.join(handed, list(keys))
    fixed = joined.withColumns({f"{c}_so_far": F.when(first, F.col(f"{c}_handed")).otherwise(F.col(f"{c}_so_far")) for c in SUMS})
    return _derived(fixed.drop(*(f"{c}_handed" for c in SUMS)))


def days_rest(events: DataFrame, entity: str, session: str, day: str) -> DataFrame:
    """(entity, session, day, days_rest): days since the entity's previous session."""
    starts = events.where(F.col(entity).isNotNull()).groupBy(entity, session).agg(F.min(day).alias("day"))
    w = Window.partitionBy(entity).orderBy("day", session)
    return starts.select(entity, session, "day", F.datediff("day", F.lag("day").over(w)).alias("days_rest"))


def first_non_null(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], columns: Sequence[str], last: bool = False) -> DataFrame:
    """One row a key with each column's first (or last) non-null value in order; null keys are left out.

    One aggregation with map-side combine: the order travels with the value as a struct.
    """
    at = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    pick = F.max_by if last else F.min_by
    known = [pick(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns]
    present = df
    for k in keys:
        present = present.where(F.col(k).isNotNull())
    return present.groupBy(*keys).agg(*known)


def latest_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The whole row that comes first in the given (descending) order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def totals(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_bf"), *(F.sum(c).alias(f"total_{c}") for c in SUMS))


def survival_long(starts: DataFrame, remaining: str = "remaining_bf", horizon: int = 36) -> DataFrame:
    """One row for each step up to the horizon, with the flag that the session ends there."""
    steps = F.explode(F.sequence(F.lit(1), F.least(F.lit(horizon), F.col(remaining).cast("int"))))
    long = starts.where(F.col(remaining) >= 1).withColumn("future_bf_step", steps)
    return long.withColumn("stops", (F.col("future_bf_step") == F.col(remaining)).cast("int"))


def lineup_quality(events: DataFrame, keys: Sequence[str], batter: str, measures: Sequence[str]) -> DataFrame:
    """Means over batters of each batter's first non-null value, so that a batter counts once."""
    per_batter = first_non_null(events, [*keys, batter], ORDER, measures)
    return per_batter.groupBy(*keys).agg(F.count(F.lit(1)).alias("batters"), *(F.avg(m).alias(f"lineup_mean_{m}") for m in measures))


def lineup_order(events: DataFrame, keys: Sequence[str], batter: str, place: str = "pa_number") -> DataFrame:
    """Batters in order of first appearance, numbered from 1, as an array. A session's batters are few by nature."""
    firsts = events.where(F.col(batter).isNotNull()).groupBy(*keys, batter).agg(F.min(place).alias("first_place"))
    return firsts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("first_place", batter))), lambda x: x[batter]).alias("lineup"))


def median_fill(df: DataFrame, columns: Sequence[str], training: Column | None = None) -> DataFrame:
    """Nulls become the column's exact median, over all rows or those where `training` holds; without values they stay."""
    base = df if training is None else df.where(training)
    medians = {c: exact_quantiles(base, c, [0.5])[0] for c in columns}
    return df.withColumns({c: F.coalesce(c, F.lit(m)) for c, m in medians.items() if m is not None})


def prior_season(left: DataFrame, right: DataFrame, keys: Sequence[str], season: str) -> DataFrame:
    """Left join on the keys with the season before; null keys never match."""
    return left.join(right.dropDuplicates([*keys, season]).withColumn(season, F.col(season) + 1), [*keys, season], "left")


def outer_merge(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer joins of parts that share the keys."""
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, list(keys), "outer")
    return out


def pitch_summary(pitches: Column) -> dict[str, Column]:
    """Aggregates of an array of pitch structs: means skip nulls, last_* is the last element's, shares of types are over
    the pitches that have one."""
    n = F.size(pitches)
    def avg(field: str) -> Column:
        known = F.filter(pitches, lambda p: p[field].isNotNull())
        return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, p: s + p[field]) / F.size(known))

    def share(test) -> Column:
        return F.when(n > 0, F.size(F.filter(pitches, test)) / n)

    named = F.filter(pitches, lambda p: p["pitch_type_code"] != "")

    def type_share(codes: Sequence[str]) -> Column:
        return F.when(F.size(named) > 0, F.size(F.filter(named, lambda p: p["pitch_type_code"].isin(*codes))) / F.size(named))

    #: Fixed code sets.
    fast, breaking, off = ("FF", "SI", "FC"), ("SL", "CU", "KC", "SV"), ("CH", "FS", "FO", "SC")
    return {
        "pitch_count_pa": n,
        **{f"avg_{c}": avg(c) for c in ("release_speed", "spin_rate", "release_extension", "plate_x", "plate_z")},
        "fastball_share_pa": type_share(fast),
        "breaking_share_pa": type_share(breaking),
        "offspeed_share_pa": type_share(off),
        "zone_rate_pa": share(lambda p: p["strike_zone"].between(1, 9)),
        "strikes_seen_pa": F.size(F.filter(pitches, lambda p: p["pitch_call"].isin("S", "X"))),
        "last_release_speed": F.try_element_at(pitches, F.lit(-1))["release_speed"],
        "last_pitch_type_code": F.try_element_at(pitches, F.lit(-1))["pitch_type_code"],
    }


#: Fixed names: means of movement, and fields of the last pitch under the names they get.
MOVEMENTS = ("induced_vertical_break", "horizontal_movement")
LAST_FIELDS = {
    "last_pitch_number": "pitch_number", "last_balls": "balls", "last_strikes": "strikes", "last_spin_rate": "spin_rate", "last_release_extension": "release_extension",
    "last_plate_x": "plate_x", "last_plate_z": "plate_z", "last_strike_zone": "strike_zone", "last_hmov": "horizontal_movement", "last_vmov": "vertical_movement",
    "last_ivb": "induced_vertical_break", "last_exit_velocity": "exit_velocity", "last_launch_angle": "launch_angle", "last_xba_contact": "expected_batting_average",
    "game_pitch_count": "game_pitch_count", "pitcher_pitch_count": "pitcher_pitch_count",
}


def pitch_features(df: DataFrame, pitches: str = "pitches") -> DataFrame:
    """pitch_summary(), the mean movements and the rest of the last pitch, in place of the array column.

    A field that the array's struct lacks is null; a null array is an empty one; a last pitch that is not known to be a
    barrel is none.
    """
    element = df.schema[pitches].dataType.elementType
    doubles = ("release_speed", "spin_rate", "release_extension", "plate_x", "plate_z", *MOVEMENTS)
    kinds = {**dict.fromkeys(LAST_FIELDS.values(), "double"), **dict.fromkeys(doubles, "double"), "pitch_type_code": "string", "strike_zone": "int", "pitch_call": "string", "is_barrel": "boolean"}

    def whole(p: Column) -> Column:
        return F.struct(*((p[f].cast(k) if f in element.fieldNames() else F.lit(None).cast(k)).alias(f) for f, k in kinds.items()))

    at = F.transform(F.coalesce(F.col(pitches), F.array().cast(df.schema[pitches].dataType)), whole)
    out = df.withColumn(pitches, at)
    a, last = F.col(pitches), F.try_element_at(F.col(pitches), F.lit(-1))

    def mean(field: str) -> Column:
        known = F.filter(a, lambda p: p[field].isNotNull())
        return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda total, p: total + p[field]) / F.size(known))

    return out.withColumns({
        **pitch_summary(a), **{f"avg_{m}": mean(m) for m in MOVEMENTS}, **{name: last[f] for name, f in LAST_FIELDS.items()},
        "last_is_barrel": F.coalesce(last["is_barrel"].cast("int"), F.lit(0)),
    }).drop(pitches)


def merge_priors(frame: DataFrame, player_map: DataFrame, priors: dict[str, DataFrame], season: str | None = "season") -> DataFrame:
    """Joins external values of the season before to each entity: `priors` maps an entity ("pitcher") to a table of
    (mlbam_id, season, ext_<entity>_*), `player_map` has (player_id, mlbam_id).

    Of several external ids of one player the smallest counts. Without a season the values join by id alone. No row of the
    frame is lost or doubled.
    """
    ids = player_map.dropna(subset=["player_id", "mlbam_id"]).groupBy("player_id").agg(F.min("mlbam_id").alias("mlbam_id"))
    for entity, prior in priors.items():
        own = f"{entity}_mlbam_id"
        frame = frame.join(ids.select(F.col("player_id").alias(f"{entity}_id"), F.col("mlbam_id").alias(own)), f"{entity}_id", "left")
        values = [c for c in prior.columns if c.startswith(f"ext_{entity}_")]
        if season and season in prior.columns and season in frame.columns:
            frame = prior_season(frame, prior.select(F.col("mlbam_id").alias(own), season, *values), [own], season)
        else:
            frame = frame.join(prior.select(F.col("mlbam_id").alias(own), *values).dropDuplicates([own]), own, "left")
    return frame
