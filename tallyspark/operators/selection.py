"""Gates, cards, sweeps, holdouts and stakes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import odds as O
from ..functions import text as TX
from .features import latest_row
from .lineage import settled
from .metrics import running_by_score
from .ranges import last_rows

MIN_EV, MIN_CONFIDENCE = 0.20, 0.10


def strict_gate(min_ev: float = MIN_EV, min_confidence: float = MIN_CONFIDENCE) -> Column:
    return F.coalesce((F.col("best_ev") >= min_ev) & (F.col("conf_dist") >= min_confidence), F.lit(False))


def with_tier(rows: DataFrame) -> DataFrame:
    return rows.withColumn("action_tier", F.when(strict_gate(), "bet").when(F.col("best_ev") > 0, "watch").otherwise("pass"))


def books(rows: DataFrame, keys: Sequence[str] = ("game_id", "player_id", "line_value", "best_side")) -> DataFrame:
    return rows.groupBy(*keys).agg(F.countDistinct("vendor").alias("books"), F.avg("best_ev").alias("mean_ev"), F.median("best_ev").alias("median_ev"))


def card(candidates: DataFrame, summary: DataFrame | None, max_distance: float | None = None, min_books: int = 1, distance_weight: float = 0.10, limit: int | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """Gate, distance to the market mean, cross-book count, score, best per bet, best per player, and the cap.

    Without a summary the score is value plus a quarter of confidence; with it, books and vendors add to it and
    distance takes from it. The cap is the feature: a report of the best `limit`.
    """
    rows = candidates.where(strict_gate())
    score = F.col("best_ev") + 0.25 * F.col("conf_dist")
    if summary is not None:
        rows = rows.join(summary, ["game_id", "player_id"], "left")
        rows = rows.withColumn("distance", F.coalesce(F.abs(F.col("line_value") - F.col("market_mean")), F.lit(999.0))).where(F.col("distance") <= max_distance)
        keys = ["game_id", "player_id", "line_value", "best_side"]
        rows = rows.join(books(rows, keys).select(*keys, "books"), keys).where(F.col("books") >= min_books)
        score = score + 0.10 * F.col("books") + 0.05 * F.col("vendor_count") - distance_weight * F.col("distance")
    rows = rows.withColumn("score", score)
    order = [F.round("score", 9).desc(), F.round("best_ev", 9).desc(), F.round("conf_dist", 9).desc(), F.round("market_prob", 9).asc(), *(F.col(c).asc() for c in ties)]
    per_bet = latest_row(rows, ["game_id", "player_id", "line_value", "best_side"], order)
    best = latest_row(per_bet, ["game_id", "player_id"], order)
    return best.orderBy(*order).limit(limit) if limit else best


def quote_summary(quotes: DataFrame) -> DataFrame:
    """(game_id, player_id, market_mean, vendor_count): the mean line weighted evenly, and the vendors that quote."""
    return quotes.groupBy("game_id", "player_id").agg(F.avg("line_value").alias("market_mean"), F.countDistinct("vendor").alias("vendor_count"))


def gate_rows(rows: DataFrame, side: str | None = None) -> DataFrame:
    """Rows (best_ev, model_over_prob, market_over_prob, actual_over and any others) as gates and their metrics read them.

    The side is that of the column `side`, or else over unless under's value is higher, a missing value being the lowest.
    Adds side, model_prob, market_prob and actual of that side and conf_dist. Infinities count as missing, and rows without
    one of the numbers, or whose given side is neither over nor under, are left out.
    """
    lowest = lambda c: F.coalesce(F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double")), F.lit(float("-inf")))
    chosen = F.when(lowest("over_ev") >= lowest("under_ev"), "over").otherwise("under") if side is None else TX.side(F.col(side))
    numbers = {c: O.clean(F.col(c).try_cast("double")) for c in ("best_ev", "model_over_prob", "market_over_prob", "actual_over")}
    out = rows.withColumn("side", chosen).withColumns(numbers)
    over = F.col("side") == "over"
    sided = {n: F.when(over, F.col(c)).otherwise(1 - F.col(c)) for n, c in (("model_prob", "model_over_prob"), ("market_prob", "market_over_prob"), ("actual", "actual_over"))}
    return out.withColumns(sided | {"conf_dist": F.abs(F.col("model_over_prob") - 0.5)}).dropna(subset=["side", *numbers])


#: The columns that a sweep reads.
SWEPT = ("vendor", "line_value", "best_side", "best_ev", "conf_dist", "over_hit", "under_hit", "model_prob", "market_prob")


def gate_sweep(rows: DataFrame, edges: Sequence[float], confidences: Sequence[float], least: int = 20) -> DataFrame:
    """Metrics of every gate (edge, confidence) over vendors, lines, both and all.

    A row passes a gate if its value and confidence reach it; the row is counted once in the cell of the highest
    thresholds it reaches, and the grid's sums are taken over cells, so rows are not copied for each gate.
    """
    top = lambda c, steps: F.size(F.filter(F.array(*map(F.lit, steps)), lambda s: s <= F.col(c)))
    hit = F.when(F.col("best_side") == "over", F.col("over_hit")).otherwise(F.col("under_hit"))
    model, market = F.col("model_prob"), F.col("market_prob")
    sums = {
        "hits": hit, "ev": F.col("best_ev"), "log_loss_gain": O.log_loss(market, hit) - O.log_loss(model, hit),
        "brier_gain": O.brier(market, hit) - O.brier(model, hit), "model": model, "market": market, "confidence": F.col("conf_dist"),
    }
    cells = rows.withColumns({"e": top("best_ev", edges), "c": top("conf_dist", confidences), **{f"s_{n}": e for n, e in sums.items()}})
    cells = cells.where("e > 0 AND c > 0").groupBy("vendor", "line_value", "e", "c").agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"s_{n}").alias(n) for n in sums))
    grid = cells.select("*", F.explode(F.sequence(F.lit(1), F.col("e"))).alias("ei")).select("*", F.explode(F.sequence(F.lit(1), F.col("c"))).alias("ci"))
    at = lambda c, steps: F.element_at(F.array(*map(F.lit, steps)), F.col(c))
    sets = [["ei", "ci"], ["ei", "ci", "vendor"], ["ei", "ci", "line_value"], ["ei", "ci", "vendor", "line_value"]]
    out = grid.groupingSets(sets, "ei", "ci", "vendor", "line_value").agg(F.sum("n").alias("n"), *(F.sum(n).alias(n) for n in sums))
    mean = lambda n: F.col(n) / F.col("n")
    total = rows.agg(F.count(F.lit(1)).alias("total"))  # one row
    return out.where(F.col("n") >= least).crossJoin(F.broadcast(total)).select(
        at("ei", edges).alias("min_ev"), at("ci", confidences).alias("min_conf"), F.coalesce("vendor", F.lit("ALL")).alias("vendor"),
        F.coalesce(F.col("line_value").cast("string"), F.lit("ALL")).alias("line"), "n", (F.col("n") / F.col("total")).alias("coverage"), mean("hits").alias("hit_rate"), mean("ev").alias("mean_ev"),
        mean("log_loss_gain").alias("log_loss_gain"), mean("brier_gain").alias("brier_gain"), mean("model").alias("mean_model"),
        mean("market").alias("mean_market"), mean("confidence").alias("mean_conf"),
    )


def choose_gate(sweep: DataFrame, tolerance: float = 1e-4, small: float = 1e-6) -> dict | None:
    """The best gate of a sweep that beats the market on both scores, by a fold in grid order.

    Later gates win by log-loss gain, then Brier gain, value, hit rate and size, each beyond its tolerance; that is not
    transitive, so the order is fixed. The grid is small by definition (gates times vendors times lines).
    """
    best = None
    levels = (("log_loss_gain", tolerance), ("brier_gain", tolerance), ("mean_ev", small), ("hit_rate", small), ("n", 0))
    for row in sweep.where("log_loss_gain > 0 AND brier_gain > 0").orderBy("min_ev", "min_conf", "vendor", "line").collect():
        if best is not None:
            for name, slack in levels:
                if row[name] > best[name] + slack:
                    best = row
                    break
                if abs(row[name] - best[name]) > slack:
                    break
        else:
            best = row
    return best.asDict() if best is not None else None


def gated(rows: DataFrame, gate: dict) -> DataFrame:
    kept = rows.where((F.col("best_ev") >= gate["min_ev"]) & (F.col("conf_dist") >= gate["min_conf"]))
    if gate["vendor"] != "ALL":
        kept = kept.where(F.col("vendor") == gate["vendor"])
    return kept if gate["line"] == "ALL" else kept.where(F.col("line_value").cast("string") == gate["line"])


def gate_holdout(rows: DataFrame, edges: Sequence[float], confidences: Sequence[float], ts: str = "snapshot_ts", least_test: int = 10) -> dict:
    """Chooses a gate on the earlier groups and verifies it on the later ones: {accepted, gate, n_test, ...}."""
    wanted = dict.fromkeys(["game_id", "player_id", ts, *SWEPT])
    split = settled(group_holdout(rows.select(*wanted), ["game_id", "player_id"], ts))  # both sweeps read it twice
    gate = choose_gate(gate_sweep(split.where("not is_eval"), edges, confidences))
    if gate is None:
        return {"accepted": False, "reason": "no training gate beats the market on both scores"}
    test = gate_sweep(gated(split.where("is_eval"), gate), [gate["min_ev"]], [gate["min_conf"]], least=1).where("vendor = 'ALL' AND line = 'ALL'").first()
    if test is None or test["n"] < least_test:
        return {"accepted": False, "gate": gate, "reason": "too few test rows"}
    return {"accepted": test["log_loss_gain"] > 0 and test["brier_gain"] > 0, "gate": gate, "test": test.asDict()}


RULES = {"edge": 0.025, "ev": 0.015, "uncertainty": 0.06, "vendor_count": 1}


def rule_filter() -> Column:
    return F.coalesce((F.col("edge") >= RULES["edge"]) & (F.col("ev") >= RULES["ev"]) & (F.col("uncertainty") <= RULES["uncertainty"]) & (F.col("vendor_count") >= RULES["vendor_count"]), F.lit(False))


FILTER_FEATURES = ("edge", "ev", "uncertainty", "vendor_count", "abs_gap", "is_live")


def learned_filter(history: DataFrame, candidates: DataFrame, least: int = 250, threshold: float = 0.55) -> DataFrame:
    """Adds selection_score and selected: the rules, and a logistic score of them if history (with `won`) has enough rows of both kinds."""
    # The fit reads the history several times: its few columns are written once.
    history = settled(history.select(*FILTER_FEATURES, "won"))
    counts = history.groupBy("won").count().collect()
    ruled = candidates.withColumn("pass_rules", rule_filter())
    if sum(r["count"] for r in counts) < least or len(counts) < 2:
        return ruled.withColumns({"selection_score": F.col("pass_rules").cast("double"), "selected": F.col("pass_rules").cast("int")})
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    assemble = VectorAssembler(inputCols=list(FILTER_FEATURES), outputCol="_x")
    n = sum(r["count"] for r in counts)
    model = LogisticRegression(featuresCol="_x", labelCol="won", regParam=1 / (0.5 * n), standardization=False, maxIter=200, probabilityCol="_p").fit(assemble.transform(history.na.fill(0, list(FILTER_FEATURES)).withColumn("won", F.col("won").cast("double"))))
    scored = model.transform(assemble.transform(ruled.na.fill(0, list(FILTER_FEATURES)))).withColumn("selection_score", vector_to_array("_p")[1])
    return scored.select(*ruled.columns, "selection_score", (F.col("pass_rules") & (F.col("selection_score") >= threshold)).cast("int").alias("selected"))


def time_split(df: DataFrame, day: str, share: float = 0.8) -> DataFrame:
    """Adds is_train: the first `share` of the distinct days."""
    days = df.select(day).where(F.col(day).isNotNull()).distinct()
    ranked = days.select(day, F.row_number().over(Window.orderBy(day)).alias("place"))  # one row a day
    cutoff = ranked.agg(F.count(F.lit(1)).alias("days")).select(F.greatest(F.lit(1), F.floor(F.col("days") * share) - 1).alias("index"))
    last = ranked.join(F.broadcast(cutoff), F.col("place") == F.col("index") + 1).select(F.col(day).alias("cutoff_day"))
    return df.crossJoin(F.broadcast(last)).withColumn("is_train", F.col(day) <= F.col("cutoff_day")).drop("cutoff_day")


def group_holdout(df: DataFrame, keys: Sequence[str], ts: str, share: float = 0.3, held_of: Callable[[int], int] | None = None) -> DataFrame:
    """Adds is_eval: whole groups, the last `share` of them by their latest time (then by key).

    `held_of` gives the number of groups to hold out from the number of groups, in place of `share`.

    The boundary time comes from counts of distinct times in ranges; only groups with that very time are ranked by key.
    `df` is read twice: for its groups, which are written once as a row each, and for the rows that get their flag.
    """
    kind = df.schema[ts].dataType
    number = F.unix_micros(F.col(ts).cast("timestamp")) if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else F.col(ts)
    groups = settled(df.groupBy(*keys).agg(F.coalesce(F.max(number.cast("double")), F.lit(float("-inf"))).alias("p")))
    total = groups.count()
    kept = total - (held_of(total) if held_of else int(total * share))
    places = running_by_score(groups.select("p", F.lit(0).alias("y")), descending=False)
    edge = places.where((F.col("n_before") <= kept) & (F.col("n_before") + F.col("n") > kept)).first()
    if edge is None:
        return df.withColumn("is_eval", F.lit(False))
    # Groups of the boundary time alone are put in order, in ranges, as there may be very many of them.
    tied = last_rows(groups.where(F.col("p") == edge.p), list(keys), int(edge.n_before + edge.n - kept), "is_eval").select(*keys, "is_eval")
    held = groups.where(F.col("p") != edge.p).select(*keys, (F.col("p") > edge.p).alias("is_eval")).unionByName(tied)
    return df.join(held, list(keys), "left")


#: The groups that a holdout needs, and the least of them that it holds out.
LEAST_GROUPS, LEAST_HELD = 20, 10


def guarded_held(groups: int, share: float = 0.3) -> int:
    """The groups to hold out of so many: the share, rounded, but LEAST_HELD at least; too few groups are an error."""
    if groups < LEAST_GROUPS:
        raise ValueError(f"a holdout needs {LEAST_GROUPS} groups, there are {groups}")
    held = max(LEAST_HELD, round(groups * share))
    return held if held < groups else max(1, groups - 1)


def guarded_holdout(df: DataFrame, keys: Sequence[str], ts: str, share: float = 0.3) -> DataFrame:
    """group_holdout() of guarded_held() groups. A group is on one side only, as its rows get its flag by a join."""
    return group_holdout(df, keys, ts, held_of=lambda groups: guarded_held(groups, share))


def exact_sample(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows in the order of a seeded hash of their keys."""
    return df.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(n)


#: Caps of a bet, a board and a game, the bankroll, and correlations of two bets.
CAP, BOARD_CAP, GAME_CAP, BANKROLL = 0.0125, 0.05, 0.025, 10_000.0
SAME_PLAYER, SAME_GAME, OTHERS = 0.65, 0.30, 0.05


def _stakes(pdf: pd.DataFrame) -> pd.DataFrame:
    """Mean-variance stakes of one board by projected gradient; at most BOARD_CAP in all, GAME_CAP a game."""
    p, gain, ev = pdf["prob"].to_numpy(float), pdf["decimal_odds"].to_numpy(float) - 1, pdf["ev"].to_numpy(float)
    cap = np.minimum(CAP, np.maximum(0, pdf["stake_kelly"].to_numpy(float) * np.maximum(0, 1 - pdf["uncertainty"].to_numpy(float))))
    spread = np.sqrt(np.maximum(p * gain**2 + (1 - p) - ev**2, 1e-8))
    game, player, both = (np.unique(k, return_inverse=True)[1] for k in (pdf["game_id"].astype(str), pdf["player_id"].astype(str), pdf["game_id"].astype(str) + "/" + pdf["player_id"].astype(str)))

    def covered(w: np.ndarray) -> np.ndarray:
        """The covariance times w: correlations are constant within a player, a game and the board, so sums replace the matrix."""
        x = spread * w
        of = lambda k: np.bincount(k, x)[k]
        return spread * (OTHERS * x.sum() + (SAME_PLAYER - OTHERS) * of(player) + (SAME_GAME - OTHERS) * (of(game) - of(both)) + (1 - SAME_PLAYER) * x)

    top = spread / np.linalg.norm(spread)
    for _ in range(100):  # its largest eigenvalue, which bounds the step
        top = covered(top)
        norm = np.linalg.norm(top)
        top = top / norm
    w = np.minimum(cap, BOARD_CAP / max(len(p), 1))
    step = 1.0 / max(norm, 1e-9)
    for _ in range(500):
        v = w + step * (ev - covered(w))
        low, high = 0.0, max(float(np.max(v, initial=0)), 0.0)
        if np.clip(v, 0, cap).sum() > BOARD_CAP:
            for _ in range(60):
                mid = (low + high) / 2
                low, high = (mid, high) if np.clip(v - mid, 0, cap).sum() > BOARD_CAP else (low, mid)
            v = v - high
        new = np.clip(v, 0, cap)
        if np.abs(new - w).max(initial=0) < 1e-12:
            break
        w = new
    held = np.bincount(game, w)
    w = w * np.minimum(1.0, GAME_CAP / np.maximum(held, GAME_CAP))[game]
    return pdf.assign(weight=w, stake=w * BANKROLL)


def size_stakes(selected: DataFrame, board: str) -> DataFrame:
    """Adds weight and stake; a board (the day's selected bets) is sized as one. Vendors stay apart."""
    schema = T.StructType([*selected.schema, T.StructField("weight", T.DoubleType()), T.StructField("stake", T.DoubleType())])
    return selected.groupBy(board).applyInPandas(_stakes, schema)


def kelly_columns(rows: DataFrame, prob: str, odds: str) -> DataFrame:
    return rows.withColumns({"decimal_odds": 1 + O.profit(F.col(odds)), "ev": O.expected_value(F.col(prob), F.col(odds)), "stake_kelly": O.kelly(F.col(prob), F.col(odds))})
