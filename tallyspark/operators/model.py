"""Two boosted classifiers over event features, and the count distribution that follows from them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HORIZON = 36
MAX_COUNT = 20


def fit_classifier(df: DataFrame, features: Sequence[str], label: str, rounds: int = 350, depth: int = 4, rate: float = 0.04) -> GBTClassificationModel:
    """Missing features count as zero."""
    rows = df.na.fill(0, list(features)).select(*(F.col(c).cast("double").alias(c) for c in features), F.col(label).cast("double").alias("label"))
    assembled = VectorAssembler(inputCols=list(features), outputCol="features").transform(rows)
    return GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=0.85, seed=42).fit(assembled.select("features", "label"))


@dataclass
class Forest:
    """A fitted model's trees as flat arrays, so that workers can score inside a simulation."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    weights: np.ndarray

    @staticmethod
    def of(model: GBTClassificationModel) -> Forest:
        nodes: list[list[float]] = []

        def add(node) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, at, at, node.prediction()])
            if node.subtreeDepth():
                split = node.split()
                nodes[at][:2] = [split.featureIndex(), split.threshold()]
                nodes[at][2] = add(node.leftChild())
                nodes[at][3] = add(node.rightChild())
            return at

        roots = [add(t._call_java("rootNode")) for t in model.trees]
        n = np.array(nodes, float)
        return Forest(n[:, 0].astype(int), n[:, 1], n[:, 2].astype(int), n[:, 3].astype(int), n[:, 4], np.array(roots), np.array(model.treeWeights))

    def probability(self, x: np.ndarray) -> np.ndarray:
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        while (inner := self.feature[at] >= 0).any():
            go_left = x[rows, np.maximum(self.feature[at], 0)] <= self.threshold[at]
            at = np.where(inner, np.where(go_left, self.left[at], self.right[at]), at)
        return 1 / (1 + np.exp(-2 * (self.value[at] @ self.weights)))


def event_mix(p: np.ndarray, walk: np.ndarray, hit: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, ...]:
    """(strikeout, walk, hit, out) rates of one step; together at most .985."""
    k = np.clip(p, 1e-4, 0.95)
    bb = np.clip(np.where(np.isnan(walk), 0.08, walk), 0.01, 0.20)
    h = np.clip(np.where(np.isnan(hit), 0.22, hit), 0.05, 0.40)
    in_play = np.maximum(1e-5, np.clip(np.where(np.isnan(out), 0.70, out), 0.45, 0.90) - k)
    scale = np.minimum(1, 0.985 / (k + bb + h + in_play))
    return k * scale, bb * scale, h * scale, (k + in_play) * scale


def count_mixture(steps: np.ndarray, remaining: np.ndarray, size: int) -> np.ndarray:
    """[rows, size]: sum over n of P(n steps remain) times the distribution of successes in the first n steps.

    One pass: the running distribution grows by a step and is added with its weight; what passes the last cell stays in it.
    """
    rows, horizon = steps.shape
    run = np.zeros((rows, size))
    run[:, 0] = 1
    out = run * remaining[:, :1]
    for t in range(horizon):
        p = np.clip(steps[:, t : t + 1], 0, 1)
        moved = run * p
        run = run - moved
        run[:, 1:] += moved[:, :-1]
        run[:, -1] += moved[:, -1]
        out += run * remaining[:, t + 1 : t + 2]
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1e-12)


def simulate(states: DataFrame, success: Forest, stop: Forest, features: Sequence[str], stop_features: Sequence[str], keep: Sequence[str], horizon: int = HORIZON, size: int = MAX_COUNT + 1) -> DataFrame:
    """Adds pmf to `keep`: all rows of a batch advance together, step by step, with the expected state fed back.

    States need bf_so_far, pitches_so_far, pitches_per_bf and the rates walk_rate, hit_rate, out_rate; features may use
    them, future_bf_step, times_through and heavy_workload.
    """
    wanted = sorted({*features, *stop_features, "bf_so_far", "pitches_so_far", "pitches_per_bf", "walk_rate", "hit_rate", "out_rate"} - {"future_bf_step", "times_through", "heavy_workload"})
    schema = T.StructType([*states.select(*keep).schema, T.StructField("pmf", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            state = {c: pdf[c].to_numpy(float, na_value=np.nan).copy() for c in wanted}
            rates = [state[c].copy() for c in ("walk_rate", "hit_rate", "out_rate")]
            state = {c: np.nan_to_num(v) for c, v in state.items()}
            n = len(pdf)
            steps, left, alive = np.zeros((n, horizon)), np.zeros((n, horizon + 1)), np.ones(n)
            for t in range(horizon):
                state |= {"future_bf_step": np.full(n, t + 1.0), "times_through": np.floor(state["bf_so_far"] / 9), "heavy_workload": ((state["pitches_so_far"] >= 75) | (state["bf_so_far"] >= 18)).astype(float)}
                steps[:, t] = success.probability(np.stack([state[c] for c in features], axis=1))
                hazard = stop.probability(np.stack([state[c] for c in stop_features], axis=1))
                left[:, t + 1] = alive * hazard
                alive = alive * (1 - hazard)
                mix = event_mix(steps[:, t], *rates)
                for name, gained in zip(("is_strikeout", "is_walk", "is_hit", "is_out"), mix, strict=True):
                    if f"{name}_so_far" in state:
                        state[f"{name}_so_far"] = state[f"{name}_so_far"] + gained
                state["bf_so_far"] = state["bf_so_far"] + 1
                state["pitches_so_far"] = state["pitches_so_far"] + np.where(state["pitches_per_bf"] > 0, state["pitches_per_bf"], 4.0)
            left[:, horizon] += alive
            out = pdf[list(keep)].copy()
            out["pmf"] = list(count_mixture(steps, left, size))
            yield out

    return states.select(*dict.fromkeys([*keep, *wanted])).mapInPandas(run, schema)
