"""The live board fed by a stream of events, held against the board of the same events in one batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frames as FR
from ..operators.lineage import shared_folder
from ..streaming import live as L
from .boards import BET_COLUMNS, THRESHOLD, open_quotes, priced_board, with_names
from .catalogue import ORACLE_SQL, r6, register
from .games import FINISHED, SEEN, WEEK, game_entries
from .views import pa_view, quote_view


def side_entries(games: DataFrame, sides: DataFrame, history: DataFrame) -> DataFrame:
    """(game_id, pitcher_id, pmf) of the active pitchers of running games: `sides` as the stream leaves them."""
    running = FR.without_status(games, "status", FINISHED).select("game_id")
    now = sides.join(running, "game_id", "left_semi")
    met = now.select(*L.SIDE, F.explode("lineup").alias("batter_id"))
    return game_entries(now.select(*L.SIDE, "pitcher_id"), now.select("game_id", "pitcher_id", "bf", "k"), met, history)


def streamed_sides(spark: SparkSession, events: DataFrame, files: int = 4) -> DataFrame:
    """The sides after a stream of `events` has run to its end, arriving as files in the order of their time."""
    folder = f"{shared_folder(spark)}/live-{uuid.uuid4()}"
    events.select(*L.EVENT).repartitionByRange(files, "ts", "event_id").write.parquet(f"{folder}/events")
    stream = spark.readStream.schema(events.select(*L.EVENT).schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/events")
    # A game of the driver's tables lasts a week, so nothing of it is late or idle before that.
    query = L.write_sides(L.live_sides(stream, "7 days", 8 * 24), f"{folder}/sides", f"{folder}/state")
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return L.current_sides(spark, f"{folder}/sides")


def _board(spark, d):
    events = pa_view(spark, d)
    history, today = events.where(F.col("game_week") < WEEK), events.where(F.col("game_week") == WEEK)
    status = F.when(F.col("game_id") % 7 == 0, "STATUS_FINAL").when(F.col("game_id") % 7 == 3, "status_postponed").otherwise("STATUS_IN_PROGRESS")
    games = today.select("game_id").distinct().withColumn("status", status)
    sides = streamed_sides(spark, today.where(F.col("pa_number") <= SEEN))
    entries = with_names(side_entries(games, sides, history), "pitcher_id").select("game_id", "player_name", "pmf")
    quotes = with_names(quote_view(spark, d), "player_id").withColumn("game_id", WEEK * 1000 + F.col("player_id") % 50)
    return priced_board(open_quotes(quotes, F.year("commence_time") >= 1994, "primary"), entries, THRESHOLD)


@register("live_stream_summary", ORACLE_SQL["live_summary"])
def live_stream_summary(spark, d):
    return r6(_board(spark, d).summary)


@register("live_stream_bets", ORACLE_SQL["live_bets"])
def live_stream_bets(spark, d):
    return r6(_board(spark, d).bets.select(*BET_COLUMNS))
