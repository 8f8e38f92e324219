"""Streaming extension: the same latest quotes and consensus over a stream of snapshot files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import odds as O

KEYS = ("game_id", "player_id", "vendor", "line_value")


def quote_stream(spark: SparkSession, path: str, schema: T.StructType, late: str = "10 minutes") -> DataFrame:
    """Two-sided quotes with a watermark, each (cell, time) once."""
    stream = spark.readStream.schema(schema).parquet(path).withColumn("snapshot_ts", F.col("snapshot_ts").cast("timestamp"))
    return stream.withWatermark("snapshot_ts", late).dropDuplicatesWithinWatermark([*KEYS, "snapshot_ts"]).withColumn("market_over_prob", O.no_vig(F.col("over_odds"), F.col("under_odds"))).where("market_over_prob IS NOT NULL")


def latest_of_cell(quotes: DataFrame) -> DataFrame:
    """The latest price of each cell: an update-mode aggregate, equal to the batch result once the input has ended."""
    return quotes.groupBy(*KEYS).agg(F.max(F.struct("snapshot_ts", "market_over_prob")).alias("last")).select(*KEYS, "last.*")


def drift(quotes: DataFrame, length: str = "1 hour", slide: str = "15 minutes") -> DataFrame:
    """Mean price of each line in sliding windows; a window is final when the watermark passes its end."""
    w = F.window("snapshot_ts", length, slide)
    return quotes.groupBy(w, "game_id", "player_id", "line_value").agg(F.avg("market_over_prob").alias("mean_over"), F.count(F.lit(1)).alias("n"))
