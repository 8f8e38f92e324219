"""Boards of games priced by a fitted chain: probable starters before their games, active pitchers while they run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pmf as PMF
from ..operators import chain as CH
from ..operators import features as X
from ..operators import frames as FR
from . import board as B
from .boards import BET_COLUMNS, open_quotes, priced_board, with_names
from .catalogue import r6, register
from .fitted import FEATURES as PITCHER_FEATURES
from .games import FINISHED, SIDE
from .views import pa_view, quote_view

SESSION = ("game_id", "pitcher_id")
#: Those of the pitcher as of his latest event; the others follow from the state of the session.
RATES = tuple(c for c in PITCHER_FEATURES if c.startswith("pitcher_id_"))
BATTERS = ("batter_id_is_strikeout_60", "batter_id_is_hit_60")
FEATURES = (*PITCHER_FEATURES, *BATTERS)
#: Every so many events a session in the past is a state that the hazard learns from.
STRIDE = 5
#: The board's games are those of one week and the weeks before it are history: one to learn from, one to calibrate on, one
#: that nothing is fitted on. Of running games the first SEEN events are known.
WEEK, SEEN, ROUNDS = 3, 12, 20


def rated_events(events: DataFrame) -> DataFrame:
    """Events with the rolling rates of pitcher and batter."""
    pitchers = X.rolling_rates(events, "pitcher_id", ("is_strikeout", "is_hit", "is_out", "pitch_count_pa"), (15, 60))
    return X.rolling_rates(pitchers, "batter_id", ("is_strikeout", "is_hit"), (60,))


def session_history(rated: DataFrame) -> DataFrame:
    """Rated events with the state of their session; the day of a game that takes a week is the week's first."""
    day = F.date_add(F.trunc("ts", "month").cast("date"), (F.col("game_week") * 7).cast("int"))
    return X.state_so_far(rated.withColumn("day", day), SESSION)


def fit_board_chain(rated: DataFrame, rounds: int | None = None) -> CH.OutcomeModel:
    """The chain fitted on whole past games with their line-ups and the states within them."""
    chain = CH.OutcomeChain(FEATURES, SESSION, rounds, rounds, size=B.CELLS, least_days=3, held_days=1, batter_features=BATTERS, state_stride=STRIDE)
    return chain.fit(CH.settled(session_history(rated)))


def lineup_states(events: DataFrame, rated: DataFrame) -> DataFrame:
    """(game_id, half_inning, lineup): the first batters of each side with the rates of their latest event in the history.

    A batter without a history keeps his turn and has no rates.
    """
    last = X.latest_row(rated.where(F.col("batter_id").isNotNull()), ["batter_id"], [F.col("ts").desc(), F.col("event_id").desc()])
    order = X.lineup_order(events, list(SIDE), "batter_id")
    turns = order.select(*SIDE, F.posexplode(F.slice("lineup", 1, CH.PLACES)).alias("place", "batter_id"))
    met = turns.join(last.select("batter_id", *BATTERS), "batter_id", "left")
    ordered = F.array_sort(F.collect_list(F.struct("place", F.struct(*BATTERS).alias("batter"))))
    return met.groupBy(*SIDE).agg(F.transform(ordered, lambda x: x["batter"]).alias("lineup"))


def board_starts(pitchers: DataFrame, lineups: DataFrame, rated: DataFrame, so_far: DataFrame | None = None) -> DataFrame:
    """Starts for the chain, of pitchers (game_id, half_inning, pitcher_id) who meet a line-up and have a history.

    `so_far` (game_id, half_inning, pitcher_id, bf, k, pitches, faced) is what running games have seen: events, successes
    and pitches of the pitcher, and events of the side, which tell whose turn is next. Without it all are at their start.
    """
    last = X.latest_row(rated.where(F.col("pitcher_id").isNotNull()), ["pitcher_id"], [F.col("ts").desc(), F.col("event_id").desc()])
    found = pitchers.join(lineups, list(SIDE)).join(last.select("pitcher_id", *RATES), "pitcher_id")
    if so_far is None:
        found = found.withColumns({c: F.lit(0) for c in ("bf", "k", "pitches", "faced")})
    else:
        found = found.join(so_far, [*SIDE, "pitcher_id"])
    times = F.floor(F.col("bf") / 9).cast("long")
    state = {
        "bf_so_far": F.col("bf"), "pitch_count_pa_so_far": F.col("pitches"), "pitches_per_bf": F.when(F.col("bf") > 0, F.col("pitches") / F.col("bf")),
        "times_through": times, "heavy_workload": ((F.col("pitches") >= X.WORKLOAD_PITCHES) | (times >= X.WORKLOAD_TIMES)).cast("int"), "next_place": F.col("faced").cast("int"),
    }
    return found.select(*SESSION, "k", *(e.alias(n) for n, e in state.items()), *RATES, "lineup")


def board_entries(model: CH.OutcomeModel, starts: DataFrame, stage: str) -> DataFrame:
    """(game_id, pitcher_id, pmf) of the final count: what is counted so far and the distribution of what remains."""
    priced = model.staged(starts, stage)
    counted = F.array_repeat(F.lit(0.0), F.col("k").cast("int"))
    return priced.select(*SESSION, PMF.fold_tail(F.concat(counted, F.col("pmf")), B.CELLS).alias("pmf"))


def pregame_entries(model: CH.OutcomeModel, events: DataFrame, rated: DataFrame) -> DataFrame:
    """Entries of the first pitcher of each side, through all stages of the chain."""
    first = X.latest_row(events.where(F.col("pitcher_id").isNotNull()), list(SIDE), [F.col("pa_number").asc(), F.col("event_id").asc()])
    return board_entries(model, board_starts(first.select(*SIDE, "pitcher_id"), lineup_states(events, rated), rated), CH.STAGES[-1])


def live_starts(games: DataFrame, seen: DataFrame, rated: DataFrame) -> DataFrame:
    """Starts of the active pitchers of running games (game_id, status), from the events `seen` up to now alone."""
    now = seen.join(FR.without_status(games, "status", FINISHED).select("game_id"), "game_id", "left_semi")
    counts = now.groupBy(*SIDE, "pitcher_id").agg(F.count(F.lit(1)).alias("bf"), F.coalesce(F.sum("is_strikeout"), F.lit(0)).alias("k"), F.coalesce(F.sum("pitch_count_pa"), F.lit(0)).alias("pitches"))
    sides = counts.groupBy(*SIDE).agg(F.sum("bf").alias("faced"))
    return board_starts(FR.active(now, list(SIDE), "pitcher_id", ["pa_number", "event_id"]), lineup_states(now, rated), rated, counts.join(sides, list(SIDE)))


def live_entries(model: CH.OutcomeModel, games: DataFrame, seen: DataFrame, rated: DataFrame) -> DataFrame:
    """Entries of the active pitchers. Count curves and temperature belong to whole sessions, so what remains of a running
    one is priced by the calibrated classifiers."""
    return board_entries(model, live_starts(games, seen, rated), "isotonic")


# --- queries ----------------------------------------------------------------------------------------------------------


def parts(spark, d):
    """(rated history, the board week's events, its games with their status)"""
    events = pa_view(spark, d)
    today = events.where(F.col("game_week") == WEEK)
    status = F.when(F.col("game_id") % 7 == 0, "STATUS_FINAL").when(F.col("game_id") % 7 == 3, "status_postponed").otherwise("STATUS_IN_PROGRESS")
    return CH.settled(rated_events(events.where(F.col("game_week") < WEEK))), today, today.select("game_id").distinct().withColumn("status", status)


def _board(spark, d, entries: DataFrame):
    quotes = with_names(quote_view(spark, d), "player_id").withColumn("game_id", WEEK * 1000 + F.col("player_id") % 50)
    named = with_names(entries, "pitcher_id").select("game_id", "player_name", "pmf")
    # Both the summary and the bets read the entries.
    return priced_board(open_quotes(quotes, F.year("commence_time") >= 1994, "primary"), CH.settled(named))


@register("chain_pregame_bets")
def chain_pregame_bets(spark, d):
    """Open quotes of the probable starters, priced by a chain fitted on the weeks before."""
    rated, today, _ = parts(spark, d)
    return r6(_board(spark, d, pregame_entries(fit_board_chain(rated, ROUNDS), today, rated)).bets.select(*BET_COLUMNS))


@register("chain_live_summary")
def chain_live_summary(spark, d):
    """Summary of the active pitchers of running games, priced by a chain fitted on the weeks before."""
    rated, today, games = parts(spark, d)
    seen = today.where(F.col("pa_number") <= SEEN)
    return r6(_board(spark, d, live_entries(fit_board_chain(rated, ROUNDS), games, seen, rated)).summary)
