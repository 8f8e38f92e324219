"""Entity resolution and game matching as prioritised equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import quote_name, registry_name


def match_names(left: DataFrame, registry: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Adds ref_id and method to `left` (id, name): exact name, else normalised name, else override; null if none.

    `registry` is (ref_id, ref_name, rank): among several entries the smallest rank, then ref_id, wins. `overrides` is
    (id, ref_id). Null names never match. Candidates are reduced to one for each key before they are joined.
    """
    def best(key) -> DataFrame:
        first = F.min(F.struct("rank", "ref_id"))
        return registry.where(key.isNotNull()).groupBy(key.alias("key")).agg(first.alias("best")).select("key", F.col("best.ref_id").alias("found"))

    exact = best(F.col("ref_name")).select(F.col("key").alias("exact_key"), F.col("found").alias("by_exact"))
    folded = best(registry_name(F.col("ref_name"))).select(F.col("key").alias("folded_key"), F.col("found").alias("by_folded"))
    out = left.withColumn("folded", registry_name(F.col("name")))
    out = out.join(exact, out["name"] == F.col("exact_key"), "left").join(folded, F.col("folded") == F.col("folded_key"), "left")
    if overrides is not None:
        out = out.join(overrides.select(F.col("id").alias("override_id"), F.col("ref_id").alias("by_override")), F.col("id") == F.col("override_id"), "left")
    else:
        out = out.withColumn("by_override", F.lit(None).cast("long"))
    ref = F.coalesce("by_exact", "by_folded", "by_override")
    method = F.when(F.col("by_exact").isNotNull(), "exact").when(F.col("by_folded").isNotNull(), "normalised").when(F.col("by_override").isNotNull(), "override")
    return out.select(*left.columns, ref.alias("ref_id"), method.alias("method"))


def match_players(left: DataFrame, players: DataFrame, name: str = "player_name") -> DataFrame:
    """Adds player_id to `left`: the smallest id of `players` (id, full_name) whose name is the same without case, accents
    and punctuation. Null and empty names match nothing."""
    first = players.select("id", quote_name(F.col("full_name")).alias("_known")).where("_known <> ''").groupBy("_known").agg(F.min("id").alias("player_id"))
    return left.withColumn("_asked", quote_name(F.col(name))).join(first, F.col("_asked") == F.col("_known"), "left").select(*left.columns, "player_id")


def match_games(quotes: DataFrame, games: DataFrame) -> DataFrame:
    """Adds game_id to `quotes` (.., day, team): the smallest game of `games` (game_id, day, teams) whose teams include it.

    Same day; only if no game at all is played on that day, the day before, then the day after.
    """
    days = games.select(F.col("day").alias("played")).distinct()
    same = quotes.select("day", "team").distinct().join(days, F.col("day") == F.col("played"), "left").withColumn("steps", F.when(F.col("played").isNotNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(-1), F.lit(1))))
    tried = same.select("day", "team", F.posexplode("steps").alias("try", "step"))
    by_team = games.select("game_id", F.col("day").alias("game_day"), F.explode("teams").alias("game_team"))
    hits = tried.join(by_team, (F.date_add("day", F.col("step")) == F.col("game_day")) & (F.col("team") == F.col("game_team")))
    first = hits.groupBy("day", "team").agg(F.min(F.struct("try", "game_id")).alias("hit")).select("day", "team", F.col("hit.game_id").alias("game_id"))
    return quotes.join(first, ["day", "team"], "left").select(*quotes.columns, "game_id")
