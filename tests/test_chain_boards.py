"""Boards of a fitted chain against plain loops over the same events."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_chain import distributions

from tallyspark.operators import chain as CH
from tallyspark.operators import pooling as PO
from tallyspark.plans import board as B
from tallyspark.plans import chain_boards as P

DIR = "/root/testdata/sf0.01"


def test_batters_take_turns(spark):
    rows = [(1, 0, 0, [(0.1,), (0.2,), (None,)], 2, 7.0), (2, 4, 9, None, 0, 8.0), (3, 0, 0, [], 1, 9.0)]
    starts = spark.createDataFrame(rows, "game_id long, bf_so_far long, pitch_count_pa_so_far long, lineup array<struct<b:double>>, next_place int, a double").withColumn("pitches_per_bf", F.lit(None).cast("double"))
    out = CH.step_rows(starts, ["game_id"], ["a", "b"], F.sequence(F.lit(1), F.lit(5)), ["b"])
    assert "lineup" not in out.columns
    got = {(r.game_id, r.future_bf_step): (r.bf_so_far, r.a, r.b) for r in out.collect()}
    turns = [None, 0.1, 0.2, None, 0.1]
    assert got == {(g, s + 1): (bf + s, a, turns[s] if g == 1 else None) for g, bf, a in ((1, 0, 7.0), (2, 4, 8.0), (3, 0, 9.0)) for s in range(5)}


def test_states_within_sessions(spark):
    events = [(g, i, i, 3 * i, 1.0 * i, i // 9) for g, n in ((1, 12), (2, 5), (3, 1)) for i in range(n)]
    e = spark.createDataFrame(events, "game_id long, event_id long, bf_so_far long, pitch_count_pa_so_far long, pitches_per_bf double, times_through long")
    starts = spark.createDataFrame([(g, 0, 0, None, 0, n, 50 + g, 0) for g, n in ((1, 12), (2, 5), (3, 1))], "game_id long, bf_so_far long, pitch_count_pa_so_far long, pitches_per_bf double, times_through long, remaining_bf long, rate long, next_place int")
    got = sorted(tuple(r) for r in CH.states_between(e, starts, ["game_id"], 4).select("game_id", "bf_so_far", "pitch_count_pa_so_far", "remaining_bf", "times_through", "rate", "next_place").collect())
    assert got == [(1, 0, 0, 12, 0, 51, 0), (1, 4, 12, 8, 0, 51, 4), (1, 8, 24, 4, 0, 51, 8), (2, 0, 0, 5, 0, 52, 0), (2, 4, 12, 1, 0, 52, 4), (3, 0, 0, 1, 0, 53, 0)]


@pytest.fixture(scope="module")
def fitted(spark):
    rated, today, games = P.parts(spark, DIR)
    return P.fit_board_chain(rated, 3), rated, CH.settled(today), games


def plain_starts(rated, today, cut):
    """Starts by loops: (game, pitcher) -> counts, the pitcher's last rates and the turns of the side's line-up."""
    history = rated.select("pitcher_id", "batter_id", "ts", "event_id", *P.RATES, *P.BATTERS).toPandas().astype(object).sort_values(["ts", "event_id"])
    pitchers, batters = {}, {}
    for r in history.to_dict("records"):
        pitchers[r["pitcher_id"]] = [r[c] for c in P.RATES]
        batters[r["batter_id"]] = [r[c] for c in P.BATTERS]
    sides = {}
    for r in today.where(F.col("pa_number") <= cut).toPandas().sort_values(["pa_number", "event_id"]).to_dict("records"):
        if r["game_id"] % 7 not in (0, 3):
            sides.setdefault((r["game_id"], r["half_inning"]), []).append(r)
    out = {}
    for (game, _), rows in sides.items():
        active = rows[-1]["pitcher_id"]
        own = [r for r in rows if r["pitcher_id"] == active]
        if active in pitchers:
            order = list(dict.fromkeys(r["batter_id"] for r in rows))[: CH.PLACES]
            out[game, active] = (len(own), sum(r["is_strikeout"] for r in own), sum(r["pitch_count_pa"] for r in own), len(rows), pitchers[active], [batters.get(b, [None] * len(P.BATTERS)) for b in order])
    return out


@pytest.mark.parametrize("cut", [3, 12])
def test_live_entries_equal_loops_over_events_seen(spark, fitted, cut):
    model, rated, today, games = fitted
    starts = plain_starts(rated, today, cut)
    rows = []
    for (game, pitcher), (bf, _, pitches, faced, rates, lineup) in starts.items():
        for t in range(36):
            n, thrown = bf + t, pitches + t * pitches / bf
            known = dict(zip(P.RATES, rates, strict=True)) | dict(zip(P.BATTERS, lineup[(faced + t) % len(lineup)], strict=True))
            known |= {"bf_so_far": n, "pitch_count_pa_so_far": thrown, "pitches_per_bf": pitches / bf, "times_through": n // 9, "heavy_workload": int(thrown >= 85 or n // 9 >= 2)}
            rows.append((game, pitcher, t + 1, *(None if known[c] is None or known[c] != known[c] else float(known[c]) for c in P.FEATURES)))
    steps = spark.createDataFrame(rows, "game_id long, pitcher_id long, future_bf_step int, " + ", ".join(f"{c} double" for c in P.FEATURES))
    scored = CH._scored(CH._scored(steps, model.success, P.FEATURES, "p"), model.stop, [*P.FEATURES, "future_bf_step"], "h").withColumn("curve", F.lit(0))
    for c, curve in (("p", model.success_curve), ("h", model.stop_curve)):
        scored = PO.apply_curves(scored, curve, ["curve"], c, c)
    pdf = scored.select("game_id", "pitcher_id", "future_bf_step", "p", "h").toPandas().sort_values(["game_id", "pitcher_id", "future_bf_step"])
    assert len(pdf) == 36 * len(starts) > 0
    rest = distributions(pdf["p"].to_numpy().reshape(-1, 36), pdf["h"].to_numpy().reshape(-1, 36), B.CELLS)
    keys = list(zip(pdf["game_id"][::36], pdf["pitcher_id"][::36], strict=True))
    got = {(r.game_id, r.pitcher_id): np.array(r.pmf) for r in P.live_entries(model, games, today.where(F.col("pa_number") <= cut), rated).collect()}
    assert got.keys() == set(keys) == starts.keys()
    for key, own in zip(keys, rest, strict=True):
        shifted = np.zeros(B.CELLS + 40)
        shifted[starts[key][1] : starts[key][1] + B.CELLS] = own / own.sum()
        want = np.r_[shifted[: B.CELLS - 1], shifted[B.CELLS - 1 :].sum()]
        assert np.allclose(got[key], want, atol=1e-9), key
        assert got[key][: starts[key][1]].sum() == 0


def test_hazard_knows_the_state_and_the_model_comes_back_whole(spark, fitted, tmp_path):
    model, rated, today, games = fitted
    starts = P.live_starts(games, today.where("pa_number <= 12"), rated)
    first = model.distributions(starts).select(*P.SESSION, "pmf").collect()
    model.write().save(f"{tmp_path}/model")
    again = CH.OutcomeModel.load(f"{tmp_path}/model")
    assert again.of("batterFeatures") == list(P.BATTERS) and again.of("stateStride") == P.STRIDE
    assert {(r[0], r[1]): r[2] for r in again.distributions(starts).select(*P.SESSION, "pmf").collect()} == {(r[0], r[1]): r[2] for r in first}
    # Whoever has faced many already has fewer to come.
    fresh, tired = (model.distributions(starts.withColumn("bf_so_far", F.lit(n).cast("long"))).select(F.expr("aggregate(transform(pmf, (x, i) -> x * i), 0D, (s, x) -> s + x)").alias("m")).agg(F.avg("m")).first()[0] for n in (1, 14))
    assert tired < fresh


def test_starters_have_whole_distributions(spark, fitted):
    model, rated, today, _ = fitted
    entries = P.pregame_entries(model, today, rated).collect()
    starters = {(r.game_id, r.pitcher_id) for r in today.collect() if r.pa_number == 1}
    assert len(entries) == len({(r.game_id, r.pitcher_id) for r in entries}) and starters <= {(r.game_id, r.pitcher_id) for r in entries}
    assert all(len(r.pmf) == B.CELLS and abs(sum(r.pmf) - 1) < 1e-9 and min(r.pmf) >= 0 for r in entries)


def test_nothing_to_price(spark, fitted):
    model, rated, today, games = fitted
    assert P.live_entries(model, games, today.where("false"), rated).collect() == []
    unknown = today.withColumn("pitcher_id", F.col("pitcher_id") + 10**6)
    assert P.pregame_entries(model, unknown, rated).collect() == []
    no_history = P.pregame_entries(model, today.withColumn("batter_id", F.col("batter_id") + 10**6), rated)
    assert no_history.count() == P.pregame_entries(model, today, rated).count()
