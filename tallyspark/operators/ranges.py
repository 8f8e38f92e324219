"""Total orders without a task that holds them: rows are dealt into ranges of group and order, worked on within, and what
the ranges before hand over is a row for each group that goes on in the next range.

Ranges are drawn by a sample, so the dealt rows are written out once and every later step finds them in the same ranges.
A group of any size is split like any other run of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settled

#: Columns whose nulls become the column's median.
FILLED_NAMES = ("_rate_", "_xba_", "_velo_", "_spin_", "_extension_", "lineup_mean", "avg_")
FILLED_PREFIX = "ext_"
#: Columns that are filled first, with the median of which column.
FILLED_FIRST = {"days_rest": "days_rest", "avg_pitch_count_so_far": "pitch_count_pa"}


def dealt(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """`df` with `_part`, the number of a row's range of keys and order (nulls first)."""
    return settled(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Adds <c>_before: the sum of column c over the group's rows before this one. Rows that tie come in some fixed order."""
    rows = dealt(df, keys, order)
    before = Window.unboundedPreceding, -1
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(*before)
    spans = rows.groupBy(*keys, "_part").agg(*(F.sum(c).alias(f"_of_{c}") for c in sums))
    # One row for each group and range: no more than there are groups and ranges together.
    across = Window.partitionBy(*keys).orderBy("_part") if keys else Window.orderBy("_part")
    spans = spans.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_part").alias("_span"), *(F.sum(f"_of_{c}").over(across.rowsBetween(*before)).alias(f"_of_{c}") for c in sums))
    handed = spans.where(F.coalesce(*(F.col(f"_of_{c}") for c in sums)).isNotNull())
    met = F.col("_part") == F.col("_span")
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"_{k}"))
    own = rows.select("*", *(F.sum(c).over(inside).alias(f"_in_{c}") for c in sums))
    none = F.lit(0)
    return own.join(handed, met, "left").select(*df.columns, *((F.coalesce(f"_in_{c}", none) + F.coalesce(f"_of_{c}", none)).alias(f"{c}_before") for c in sums))


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, columns: Sequence[str], ties: Sequence[str] = ()) -> DataFrame:
    """`left` with the given columns of the last row of `right` with equal keys and an earlier time (then by `ties`).

    Each row has a cutoff of its own. Both tables go into one order and the last known row is brought forward, within
    ranges and then across them, so a key with very many rows is no task of its own. Rows of null keys or times find
    nothing, and find nulls.
    """
    keys = list(keys)
    found, row = F.struct(*columns), F.struct(*left.columns)
    none = lambda df, e: F.lit(None).cast(df.select(e.alias("x")).schema["x"].dataType)
    tie = F.struct(F.lit(1).alias("_"), *ties)
    asked = left.select(*keys, F.col(left_time).alias("_time"), F.lit(0).alias("_kind"), none(right, tie).alias("_tie"), row.alias("_row"), none(right, found).alias("_found"))
    known = right.dropna(subset=[*keys, right_time]).select(*keys, F.col(right_time).alias("_time"), F.lit(1).alias("_kind"), tie.alias("_tie"), none(left, row).alias("_row"), found.alias("_found"))
    rows = dealt(asked.unionByName(known), keys, ["_time", "_kind"])
    order = ("_time", "_kind", "_tie")
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    spans = rows.where("_kind = 1").groupBy(*keys, "_part").agg(F.max_by("_found", F.struct(*order)).alias("_last"))
    starts = rows.where("_kind = 0").select(*keys, "_part").distinct()
    across = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = starts.join(spans, [*keys, "_part"], "full").select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_part").alias("_span"), F.last("_last", ignorenulls=True).over(across).alias("_handed"))
    met = F.col("_part") == F.col("_span")
    for k in keys:
        met = met & (F.col(k) == F.col(f"_{k}"))
    own = rows.select("*", F.last("_found", ignorenulls=True).over(inside).alias("_in")).where("_kind = 0")
    joined = own.join(spans.where("_handed IS NOT NULL"), met, "left").withColumn("_hit", F.when(F.col("_time").isNotNull(), F.coalesce("_in", "_handed")))
    return joined.select("_row.*", *(F.col(f"_hit.{c}").alias(c) for c in columns))


def _long(df: DataFrame, columns: Sequence[str], *others: str) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns))
    return df.select(F.explode(pairs).alias("_p"), *others).select("_p.column", "_p.value", *others)


def column_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, median): the exact medians of all the columns, in one order of (column, value) counts."""
    counts = _long(df, columns).where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    placed = running(counts, ["column"], ["value"], ["n"])
    totals = placed.groupBy(F.col("column").alias("_c")).agg(F.sum("n").alias("total"))  # a row a column
    holds = lambda k: (F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n"))
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    near = placed.join(F.broadcast(totals), F.col("column") == F.col("_c")).where(holds(low) | holds(high))
    return near.groupBy("column").agg(((F.min("value") + F.max("value")) / 2).alias("median"))


def is_filled(column: str) -> bool:
    return column.startswith(FILLED_PREFIX) or any(x in column for x in FILLED_NAMES)


def fill_medians(df: DataFrame) -> DataFrame:
    """Nulls of FILLED_FIRST and of all columns that is_filled() names become medians over all rows; a column without
    values stays."""
    of = {c: source for c, source in FILLED_FIRST.items() if c in df.columns and source in df.columns}
    of |= {c: c for c in df.columns if is_filled(c) and c not in of}
    if not of:
        return df
    medians = {r.column: r.median for r in column_medians(df, sorted(set(of.values()))).collect()}
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(medians[source])) for c, source in of.items() if source in medians})


def rank_correlations(df: DataFrame, features: Sequence[str], y: str, least: int = 100) -> DataFrame:
    """(feature, n, spearman, missing_rate, std) of every feature with at least `least` values: the rank correlation with y
    over the rows where both are known, the share of nulls, and the deviation of what is there.

    All features go through one order of (feature, value) counts; ranks of ties are averaged.
    """
    long = _long(df, features, y)
    facts = long.groupBy("column").agg(F.count("value").alias("known"), F.avg(F.col("value").isNull().cast("double")).alias("missing_rate"), F.stddev_pop("value").alias("std"))
    cells = settled(long.where(F.col("value").isNotNull() & F.col(y).isNotNull()).groupBy("column", "value", F.col(y).cast("double").alias("y")).agg(F.count(F.lit(1)).alias("n")))
    totals = cells.groupBy("column").agg(F.sum("n").alias("total"))  # a row a feature

    def ranks(c: str) -> DataFrame:
        placed = running(cells.groupBy("column", c).agg(F.sum("n").alias("n")), ["column"], [c], ["n"])
        return placed.select("column", c, (F.col("n_before") + (F.col("n") + 1) / 2).alias(f"{c}_rank"))

    centre = (F.col("total") + 1) / 2
    joined = cells.join(ranks("value"), ["column", "value"]).join(ranks("y"), ["column", "y"]).join(F.broadcast(totals), "column")
    a, b = F.col("value_rank") - centre, F.col("y_rank") - centre
    sums = joined.groupBy("column").agg(F.sum("n").alias("n"), F.sum(F.col("n") * a * b).alias("ab"), F.sum(F.col("n") * a * a).alias("aa"), F.sum(F.col("n") * b * b).alias("bb"))
    found = facts.where(F.col("known") >= least).join(sums, "column", "left")
    return found.select(F.col("column").alias("feature"), F.coalesce("n", F.lit(0)).alias("n"), F.try_divide(F.col("ab"), F.sqrt(F.col("aa") * F.col("bb"))).alias("spearman"), "missing_rate", "std")


def last_rows(df: DataFrame, order: Sequence[str], held: int, out: str) -> DataFrame:
    """Adds `out`: true for the last `held` rows in rising order, nulls first."""
    total = df.count()
    placed = running(df.withColumn("_one", F.lit(1)), [], order, ["_one"])
    return placed.withColumn(out, F.col("_one_before") >= total - held).drop("_one", "_one_before")
