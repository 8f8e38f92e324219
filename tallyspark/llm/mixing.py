"""Mixing sources to target weights, in DataFrame operations only.

Words are summed per source. Sources in code point order (null last) weigh WEIGHTS in turn and share all words by
weight; no target exceeds MOST_REPEATS times its source's words, and what a full source gives up is shared again by
weight. With sources in the order of cap / weight, the level at which the open ones fill is the largest
(total - caps before) / (weights not before), so one pass over the sources settles it without iterating. A document is
then taken floor(target / source words) times, plus once more where a hash of its id falls below the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = "mix-1"
#: The table of sources is broadcast up to so many rows (of under 100 bytes and a name); beyond, it is joined by shuffle.
BROADCAST_SOURCES = 20_000
#: Sources that one task ranks, about.
SOURCES_A_RANGE = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _running(df: DataFrame, order: list[Column], sums: list[str], ranges: int) -> DataFrame:
    """Adds <column>_before: the sum of the column over all rows before, in an order without ties.

    Rows are dealt into ranges of that order, which are written out so that all readers find the same ones, summed within
    each, and the sums of the ranges before are added: no task holds more than a range, or a row a range.
    """
    ranged = checkpointed(df.repartitionByRange(ranges, *order).withColumn("mix_range", F.spark_partition_id()))
    inside = Window.partitionBy("mix_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("mix_range").rowsBetween(Window.unboundedPreceding, -1)
    spans = ranged.groupBy("mix_range").agg(*(F.sum(c).alias(c) for c in sums))
    spans = spans.select("mix_range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_span") for c in sums))
    own = ranged.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{c}_own") for c in sums))
    added = (F.col(f"{c}_own") + F.col(f"{c}_span") for c in sums)
    return own.join(spans, "mix_range").select(*df.columns, *(e.alias(f"{c}_before") for e, c in zip(added, sums, strict=True)))


def targets(sizes: DataFrame, a_range: int = SOURCES_A_RANGE) -> DataFrame:
    """(mix_source, source_size, target) of a table (source, size): one row for each source.

    Sources are ranked in ranges of about `a_range`, however many there are; only sums over all of them reach the driver.
    """
    sources = checkpointed(sizes.groupBy(F.col("source").alias("mix_source")).agg(F.sum("size").alias("source_size")))
    ranges = sources.count() // a_range + 1
    placed = _running(sources.withColumn("one", F.lit(1)), [F.col("mix_source").asc_nulls_last()], ["one"], ranges)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("one_before") % len(WEIGHTS) + 1).cast("int"))
    ranked = placed.select("mix_source", "source_size", F.col("one_before").alias("place"), weight.alias("weight"), (F.col("source_size") * MOST_REPEATS).alias("cap"))
    total, weights = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    filling = _running(ranked, [(F.col("cap") / F.col("weight")).asc(), F.col("place").asc()], ["cap", "weight"], ranges)
    level = filling.agg(F.max((F.lit(total) - F.col("cap_before")) / (F.lit(weights) - F.col("weight_before")))).first()[0]
    filled = F.least(F.col("cap").cast("double"), F.lit(level).cast("double") * F.col("weight"))
    return ranked.select("mix_source", "source_size", F.round(filled, 6).alias("target"))


_ADDED = ("mix_size", "source_size", "target", "mix_copies")


def _mixed(docs: DataFrame) -> DataFrame:
    """(mix_row, mix_size, source_size, target, mix_copies): mix_row has the columns of `docs`."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("mix_row"))
    sized = packed.withColumn("mix_size", word_count(F.col("mix_row.text")))
    sources = checkpointed(targets(sized.select(F.col("mix_row.source").alias("source"), F.col("mix_size").alias("size"))))
    if sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    joined = sized.join(sources, F.col("mix_row.source").eqNullSafe(F.col("mix_source")))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST_REPEATS)))).otherwise(0.0)
    digest = F.md5(F.concat(F.coalesce(F.col("mix_row.doc_id").cast("string"), F.lit("null")), F.lit(f":{SEED}")))
    draw = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(2.0**52)
    copies = F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")
    return joined.select("mix_row", "mix_size", "source_size", "target", copies.cast("long").alias("mix_copies"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of `docs` (doc_id, text, source and any others) with mix_size, source_size, target and mix_copies, which
    take the place of columns with these names.

    A null or empty text has size 0 and keeps its row; texts may be of any length. Rows that repeat one doc_id share a
    draw. An empty table gives an empty one; sources without words have target 0.
    """
    own = [F.col(f"mix_row.`{c}`").alias(c) for c in docs.columns if c.lower() not in _ADDED]
    return _mixed(docs).select(*own, *_ADDED)


def emitted(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of `docs` (doc_id, text, source and any others) as often as it is taken, unchanged.

    Nulls, empty and long texts, repeated rows and empty tables are as in mixed(); a text without words is taken as its
    source is. Columns keep their names and values, whatever they are.
    """
    taken = _mixed(docs).where("mix_copies > 0")
    return taken.select("mix_row", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))).alias("mix_copy")).select("mix_row.*")


def op8_source_mixing(spark, sf_dir: str) -> DataFrame:
    """mixed() over all of `documents`, in words; its edge cases hold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mixed(docs).select("doc_id", F.col("mix_size").alias("size"), "source_size", "target", (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


OP8_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \\t-\\r]+')), 0)::BIGINT AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS place,
         CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM totals),
keyed AS (SELECT *, row_number() OVER (ORDER BY source_size * 3.0::DOUBLE / weight, place) AS key FROM ranked),
levels AS (
  SELECT a.*, (SELECT (max(t.total) - coalesce(sum(b.source_size * 3) FILTER (WHERE b.key < a.key), 0))::DOUBLE
                      / (max(t.weights) - coalesce(sum(b.weight) FILTER (WHERE b.key < a.key), 0))::DOUBLE
               FROM keyed b, (SELECT sum(source_size) AS total, sum(weight) AS weights FROM ranked) t) AS level
  FROM keyed a),
target AS (SELECT source, source_size, round(least(source_size * 3.0::DOUBLE, (SELECT max(level) FROM levels) * weight), 6) AS target FROM ranked),
rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
         ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, 'null') || ':mix-1'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS draw
  FROM sized d JOIN target t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""
