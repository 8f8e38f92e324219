"""Sides of a stream against plain loops over the same events."""

import datetime as dt
import random

from tallyspark.streaming import live as L

SCHEMA = "game_id long, half_inning string, pitcher_id long, batter_id long, is_strikeout int, pa_number long, event_id long, ts timestamp"
START = dt.datetime(2024, 5, 1, 12)


def plain(events, places=9):
    sides = {}
    for e in {x["event_id"]: x for x in events if None not in (x["game_id"], x["half_inning"], x["event_id"], x["ts"])}.values():
        sides.setdefault((e["game_id"], e["half_inning"]), []).append(e)
    out = {}
    for side, rows in sides.items():
        thrown = [e for e in rows if e["pitcher_id"] is not None]
        if not thrown:
            continue
        pitcher = max(thrown, key=lambda e: (e["pa_number"], e["event_id"]))["pitcher_id"]
        own = [e for e in thrown if e["pitcher_id"] == pitcher]
        first = {}
        for e in rows:
            if e["batter_id"] is not None:
                first[e["batter_id"]] = min(e["pa_number"], first.get(e["batter_id"], e["pa_number"]))
        out[side] = (pitcher, len(own), sum(e["is_strikeout"] or 0 for e in own), sorted(first, key=lambda b: (first[b], b))[:places], len(rows))
    return out


def event(i, game, half, pitcher, batter, k, number, minutes):
    return dict(game_id=game, half_inning=half, pitcher_id=pitcher, batter_id=batter, is_strikeout=k, pa_number=number, event_id=i, ts=START + dt.timedelta(minutes=minutes))


def run(spark, folder, **options):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/events")
    query = L.write_sides(L.live_sides(stream, **options), f"{folder}/sides", f"{folder}/state")
    query.awaitTermination()
    return {(r.game_id, r.half_inning): (r.pitcher_id, r.bf, r.k, list(r.lineup), r.seen) for r in L.current_sides(spark, f"{folder}/sides").collect()}


def put(spark, folder, events):
    spark.createDataFrame([tuple(e[f.split()[0]] for f in SCHEMA.split(", ")) for e in events], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/events")


def test_any_order_repeats_nulls_and_a_restart(spark, tmp_path):
    rng, folder = random.Random(5), str(tmp_path)
    events = [event(i, rng.randrange(3), rng.choice(["top", "bottom"]), rng.choice([None, 1, 2, 3]), rng.choice([None, *range(20, 34)]), rng.choice([None, 0, 1]), i // 3, i % 40) for i in range(240)]
    events += [event(900, None, "top", 1, 2, 1, 1, 1), event(901, 7, "top", None, 20, 0, 1, 1)]
    rng.shuffle(events)
    put(spark, folder, events[:100])
    run(spark, folder, late="2 hours")
    put(spark, folder, events[80:])  # 20 events arrive again, after a restart from the checkpoint
    assert run(spark, folder, late="2 hours") == plain(events)


def test_idle_sides_start_anew(spark, tmp_path):
    folder = str(tmp_path)
    put(spark, folder, [event(1, 1, "top", 5, 50, 1, 1, 0), event(2, 2, "top", 6, 60, 1, 1, 0)])
    run(spark, folder, late="1 minute", idle_hours=1)
    put(spark, folder, [event(3, 2, "top", 6, 61, 1, 2, 59), event(4, 3, "top", 7, 70, 0, 1, 180)])
    run(spark, folder, late="1 minute", idle_hours=1)
    put(spark, folder, [event(5, 1, "top", 5, 51, 0, 2, 200), event(6, 3, "top", 7, 71, 1, 2, 200)])
    found = run(spark, folder, late="1 minute", idle_hours=1)
    assert found[(1, "top")] == (5, 1, 0, [51], 1)
    assert found[(2, "top")] == (6, 2, 2, [60, 61], 2)
    assert found[(3, "top")] == (7, 2, 1, [70, 71], 2)
