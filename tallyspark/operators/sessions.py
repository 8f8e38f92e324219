"""Distributions of sessions where they lie: an Arrow batch of starts goes through all stages of a chain at once.

A session's steps are laid out within its batch and never become rows. Its fixed features are looked up once; those that
move are looked up once for each state that occurs, as most sessions go through the same states.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..functions import pmf as PMF
from . import features as X
from .boosting import Leaves
from .model import count_mixture

#: Pitches of an event where a session has none so far.
USUAL_PITCHES = 4.0
#: Sessions that are worked on together.
SESSIONS = 256
STEP = "future_bf_step"


class Curve:
    """Segments of one rising curve, as PO.fit_curves gives them; without any, a score stays what it is."""

    def __init__(self, low: Sequence[float] = (), high: Sequence[float] = (), at_low: Sequence[float] = (), at_high: Sequence[float] = ()) -> None:
        self.low, self.high, self.at_low, self.at_high = (np.array(c, float) for c in (low, high, at_low, at_high))

    def __call__(self, p: np.ndarray) -> np.ndarray:
        if self.low.size:
            i = np.clip(np.searchsorted(self.low, p, side="right") - 1, 0, None)
            a, b, low, high = self.at_low[i], self.at_high[i], self.low[i], self.high[i]
            flat = a == b
            with np.errstate(invalid="ignore"):
                p = np.where(flat, a, a + (b - a) * (p - np.where(flat, 0.0, low)) / np.where(flat, 1.0, high - low))
        return np.clip(p, 1e-6, 1 - 1e-6)


def curves_of(table: DataFrame, by: str) -> dict[int, Curve]:
    """The curves of a fitted table by their key. n outcomes leave fewer than 2 n^(2/3) segments, which go with the model."""
    found: dict[int, list] = {}
    for r in table.select(by, "low", "high", "at_low", "at_high").collect():
        found.setdefault(r[0], []).append(tuple(r)[1:])
    return {k: Curve(*zip(*sorted(rows), strict=True)) for k, rows in found.items()}


def _doubles(column: pa.Array) -> np.ndarray:
    """Nulls are NaN."""
    return np.asarray(pc.cast(column, pa.float64()).to_numpy(zero_copy_only=False), float)


def _lists(cells: np.ndarray) -> pa.Array:
    n, size = cells.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * size, pa.int32()), pa.array(cells.ravel()))


class Pricer:
    """What a task needs to price starts; see chain.OutcomeModel for its parts."""

    def __init__(self, features: Sequence[str], batters: Sequence[str], horizon: int, size: int, success: Leaves, stop: Leaves, success_curve: Curve, stop_curve: Curve, count_curves: dict[int, Curve] | None, temperature: float) -> None:
        self.features, self.batters, self.horizon, self.size = list(features), list(batters), horizon, size
        self.success, self.stop, self.success_curve, self.stop_curve = success, stop, success_curve, stop_curve
        self.count_curves, self.temperature = count_curves, temperature

    def columns(self, found: Sequence[str]) -> list[str]:
        """Those of a table of starts that are read."""
        wanted = {*self.features, "bf_so_far", "pitch_count_pa_so_far", "pitches_per_bf", *(("lineup", "next_place") if self.batters else ())} - set(self.batters)
        return [c for c in found if c in wanted]

    def _moving(self, batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        """[sessions, steps] of the features that follow from the step; see chain.step_rows."""
        ahead = np.arange(self.horizon)
        bf, thrown, per = (_doubles(batch.column(c))[:, None] for c in ("bf_so_far", "pitch_count_pa_so_far", "pitches_per_bf"))
        faced, pitches = bf + ahead, thrown + ahead * np.where(np.isnan(per), USUAL_PITCHES, per)
        times = np.floor(faced / 9)
        out = {"bf_so_far": faced, "pitch_count_pa_so_far": pitches, "times_through": times, "heavy_workload": ((pitches >= X.WORKLOAD_PITCHES) | (times >= X.WORKLOAD_TIMES)).astype(float)}
        out = {c: v for c, v in out.items() if c in batch.schema.names}
        out[STEP] = np.broadcast_to(ahead + 1.0, faced.shape)
        if self.batters:
            lineup = batch.column("lineup")
            sizes = np.nan_to_num(_doubles(pc.list_value_length(lineup))).astype(int)[:, None]
            place = (np.nan_to_num(_doubles(batch.column("next_place"))).astype(int)[:, None] + ahead) % np.maximum(sizes, 1)
            known = np.broadcast_to(sizes > 0, place.shape)
            flat, first = lineup.flatten(), (np.cumsum(sizes) - sizes[:, 0])[:, None]
            at = np.where(known, first + place, 0)
            for c in self.batters:
                own = np.r_[_doubles(pc.struct_field(flat, c)), np.nan]
                out[c] = np.where(known, own[at], np.nan)
        return {c: np.nan_to_num(v, nan=0.0) for c, v in out.items()}

    def _chances(self, batch: pa.RecordBatch, moving: dict[str, np.ndarray], model: Leaves, features: Sequence[str]) -> np.ndarray:
        n = batch.num_rows
        fixed, state, values = {}, np.zeros((n, self.horizon), np.int64), []
        for f, c in enumerate(features):
            if c in moving:
                own = model.bins(f, moving[c])
                state = state * (model.edges[f].size + 1) + own
                values.append((f, own))
            else:
                x = np.nan_to_num(_doubles(batch.column(c)), nan=0.0) if c in batch.schema.names and c not in self.batters else np.zeros(n)
                fixed[f] = model.bins(f, x)
        _, first, at = np.unique(state, return_index=True, return_inverse=True)
        states = model.left_over({f: own.ravel()[first] for f, own in values}, len(first))
        return model.chances(model.left_over(fixed, n), states, at.reshape(n, self.horizon))

    def _counted(self, pmf: np.ndarray) -> np.ndarray:
        """Calibrated by the curves of its counts."""
        c = np.cumsum(pmf, axis=1)
        for k in range(self.size - 1):
            c[:, k] = self.count_curves.get(k, Curve())(c[:, k])
        c[:, -1] = 1.0
        out = np.maximum(np.diff(np.maximum.accumulate(c, axis=1), axis=1, prepend=0.0), 0.0)
        return out / out.sum(axis=1, keepdims=True)

    def _price(self, batch: pa.RecordBatch, stages: Sequence[str]) -> dict[str, np.ndarray]:
        moving = self._moving(batch)
        p = self._chances(batch, moving, self.success, self.features)
        h = self._chances(batch, moving, self.stop, [*self.features, STEP])

        def folded(p: np.ndarray, h: np.ndarray) -> np.ndarray:
            left, alive = np.zeros((len(p), self.horizon + 1)), np.ones(len(p))
            for t in range(self.horizon):
                left[:, t + 1] = alive * h[:, t]
                alive = alive * (1 - h[:, t])
            left[:, self.horizon] += alive
            return count_mixture(p, left, self.size)

        out = {}
        if "raw" in stages:
            out["raw"] = folded(p, h)
        if set(stages) - {"raw"}:
            out["isotonic"] = folded(self.success_curve(p), self.stop_curve(h))
        if {"count_curves", "temperature"} & set(stages):
            out["count_curves"] = self._counted(out["isotonic"])
        if "temperature" in stages:
            out["temperature"] = tempered(out["count_curves"], self.temperature)
        return out

    def price(self, batch: pa.RecordBatch, stages: Sequence[str]) -> dict[str, np.ndarray]:
        """[sessions, cells] of each stage."""
        parts = [self._price(batch.slice(a, SESSIONS), stages) for a in range(0, batch.num_rows, SESSIONS)]
        return {s: np.concatenate([np.zeros((0, self.size)), *(part[s] for part in parts)]) for s in stages}

    def added(self, named: dict[str, str]):
        """Adds distributions by name, each of a stage."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = self.price(batch, list(dict.fromkeys(named.values())))
                yield pa.RecordBatch.from_arrays([*batch.columns, *(_lists(found[s]) for s in named.values())], [*batch.schema.names, *named])

        return run

    def scores(self, stages: Sequence[str]):
        """Log score and ranked probability score of each stage, for each labelled start."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                actual = np.minimum(_doubles(batch.column("actual")), self.size - 1).astype(int)
                found = self.price(batch, stages)
                each = {f"log_{s}": -np.log(np.maximum(q[np.arange(len(q)), actual], PMF.FLOOR)) for s, q in found.items()}
                each |= {f"rps_{s}": ((np.cumsum(q, axis=1) - (np.arange(self.size) >= actual[:, None])) ** 2).mean(axis=1) for s, q in found.items()}
                yield pa.RecordBatch.from_pydict(each)

        return run

    def tempered_scores(self, steps: Sequence[float]):
        """(place, n, log_score) of each temperature: sums over batches of (pmf, actual), calibrated by their counts."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pmf = np.asarray(batch.column("pmf").flatten()).reshape(-1, self.size)
                actual = _doubles(batch.column("actual")).astype(int)
                q = self._counted(pmf)
                sums = [-np.log(np.maximum(tempered(q, t)[np.arange(len(q)), actual], PMF.FLOOR)).sum() for t in steps]
                yield pa.RecordBatch.from_pydict({"place": pa.array(range(len(steps)), pa.int32()), "n": pa.array([len(q)] * len(steps), pa.int64()), "log_score": pa.array(sums, pa.float64())})

        return run


def tempered(pmf: np.ndarray, t: float) -> np.ndarray:
    raised = np.maximum(pmf, PMF.FLOOR) ** (1 / t)
    return raised / raised.sum(axis=1, keepdims=True)
