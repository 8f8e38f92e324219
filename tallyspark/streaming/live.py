"""The live board as a stream: state held for each side of a game says who is active, what he has counted and whom he meets.

Events arrive in any order within the watermark and may arrive twice. A side's state is a row for each pitcher and each
batter it has seen, so it stays small however long the stream runs, and it is dropped once the side has been idle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

SIDE = ("game_id", "half_inning")
EVENT = (*SIDE, "pitcher_id", "batter_id", "is_strikeout", "pa_number", "event_id", "ts")
SIDES = "game_id long, half_inning string, pitcher_id long, bf long, k long, lineup array<long>, seen long"
PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SideState(StatefulProcessor):
    """Updates a side's state by a batch of its events and returns its row as it now is."""

    def __init__(self, places: int, idle_ms: int) -> None:
        self.places, self.idle_ms = places, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "pa_number long, event_id long, pitcher_id long")
        self.seen = handle.getValueState("seen", "n long, latest_ms long")
        self.counts = handle.getMapState("counts", "pitcher_id long", "bf long, k long")
        self.firsts = handle.getMapState("firsts", "batter_id long", "pa_number long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            self._add(pdf)
        row = self._row(key)
        if row is not None:
            yield row

    def _add(self, pdf: pd.DataFrame) -> None:
        n, latest = self.seen.get() if self.seen.exists() else (0, 0)
        newest = max(latest, pdf["ts"].max().value // 1_000_000)
        if newest > latest:
            if latest:
                self.handle.deleteTimer(latest + self.idle_ms)
            self.handle.registerTimer(newest + self.idle_ms)
        self.seen.update((n + len(pdf), newest))

        thrown = pdf[pdf["pitcher_id"].notna()]
        for pitcher, part in thrown.groupby("pitcher_id"):
            at = (int(pitcher),)
            bf, k = self.counts.getValue(at) if self.counts.containsKey(at) else (0, 0)
            self.counts.updateValue(at, (bf + len(part), k + int(part["is_strikeout"].fillna(0).sum())))
        if len(thrown):
            end = thrown.sort_values(["pa_number", "event_id"]).iloc[-1]
            new = int(end["pa_number"]), int(end["event_id"]), int(end["pitcher_id"])
            if not self.last.exists() or new > tuple(self.last.get()):
                self.last.update(new)
        for batter, place in pdf[pdf["batter_id"].notna()].groupby("batter_id")["pa_number"].min().items():
            at = (int(batter),)
            if not self.firsts.containsKey(at) or place < self.firsts.getValue(at)[0]:
                self.firsts.updateValue(at, (int(place),))

    def _row(self, key) -> pd.DataFrame | None:
        if not self.last.exists():
            return None
        pitcher = self.last.get()[2]
        bf, k = self.counts.getValue((pitcher,))
        order = sorted((place[0], batter[0]) for batter, place in self.firsts.iterator())
        lineup = [batter for _, batter in order[: self.places]]
        return pd.DataFrame({"game_id": [key[0]], "half_inning": [key[1]], "pitcher_id": [pitcher], "bf": [bf], "k": [k], "lineup": [lineup], "seen": [self.seen.get()[0]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.last, self.seen, self.counts, self.firsts):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def live_sides(events: DataFrame, late: str = "10 minutes", idle_hours: float = 12, places: int = 9) -> DataFrame:
    """A row of SIDES for each side that a batch has touched: the pitcher of its last event with his events and strikeouts
    so far, the first `places` batters in order of their first event, and the number of events.

    `events` is a stream with the columns EVENT. An event_id counts once, rows of null side, event or time not at all;
    events later than the watermark are dropped, and a side without a pitcher yet has no row. After `idle_hours` of
    event time without an event a side's state goes.
    """
    known = events.select(*EVENT).dropna(subset=[*SIDE, "event_id", "pa_number", "ts"])
    once = known.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(*SIDE).transformWithStateInPandas(SideState(places, int(idle_hours * 3_600_000)), outputStructType=SIDES, outputMode="Update", timeMode="EventTime")


def write_sides(sides: DataFrame, table: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts the stream. Each batch is a folder of its own under `table`, so a batch that is run again replaces itself."""
    spark = sides.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    was = spark.conf.get(PROVIDER_CONF, None)
    spark.conf.set(PROVIDER_CONF, PROVIDER)  # the stream takes a copy of the session's settings when it starts
    try:
        return sides.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        if was is None:
            spark.conf.unset(PROVIDER_CONF)
        else:
            spark.conf.set(PROVIDER_CONF, was)


def current_sides(spark: SparkSession, table: str) -> DataFrame:
    """The newest row of each side; one aggregation, the batch number travels with the row."""
    rows = spark.read.schema(f"{SIDES}, batch long").parquet(table)
    kept = [c for c in rows.columns if c not in (*SIDE, "batch")]
    return rows.groupBy(*SIDE).agg(F.max_by(F.struct(*kept), "batch").alias("_now")).select(*SIDE, "_now.*")
