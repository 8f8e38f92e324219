"""Boosted trees from counted rows: the logistic gradient boosting of Spark's GBTClassifier, whose model it returns.

Features become at most BINS bins with exact quantiles as edges, and rows that agree in bins and outcome become one with
a count. Tasks keep these rows as small integers; a level of a tree is one pass that sends on sums for each node and bin,
never rows. Pseudo-residuals are rounded to a fixed point, so sums are whole numbers and come out the same in any order:
equal rows give equal trees however they are dealt. Tables of up to BLOCK_ROWS counted rows are one task, which then
grows all trees without a job for each level.

A round takes the share of each count that a hash of the row and the round gives: floor or ceiling, right on average.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import settled
from .ranges import running

BINS = 32
#: Counted rows of a task, and of a pass within it.
BLOCK_ROWS, CHUNK = 1_000_000, 2**15
#: Combined bins of features that are counted together.
CELLS = 1_024
#: A pseudo-residual is at most 4. Those of a chunk of single rows, times SCALE, stay below half of PACKED, and PACKED times
#: CHUNK is 2^52: one double holds the sum of residuals and the count.
SCALE, PACKED = 2.0**18, 2.0**37
#: Rounds between checkpoints of the rows' state, where there is more than one task.
ROUNDS_KEPT = 50
#: Rows that are scored together.
SCORED = 512
#: Relative gain below which a split is rounding.
LEAST_GAIN = 1e-12


def edges(df: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """Rising thresholds of each feature, at most BINS - 1: between all values if these are few, else between the values
    where the BINS equal shares of the rows begin."""
    pairs = F.array(*(F.struct(F.lit(i).alias("column"), F.col(c).alias("value")) for i, c in enumerate(features)))
    counts = settled(df.select(F.explode(pairs).alias("_p")).groupBy("_p.column", "_p.value").agg(F.count(F.lit(1)).alias("n")))
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"))  # a row a feature
    many = {r.column for r in totals.where(F.col("distinct") > BINS).collect()}
    spans: list[list[tuple[float, float]]] = [[] for _ in features]
    for r in counts.where(~F.col("column").isin(many)).collect() if many else counts.collect():
        spans[r.column].append((r.value, r.value))
    if many:
        placed = running(counts.where(F.col("column").isin(many)), ["column"], ["value"], ["n"]).join(F.broadcast(totals.select(F.col("column").alias("_c"), "total")), F.col("column") == F.col("_c"))
        share = F.floor(F.col("n_before") * BINS / F.col("total"))
        for r in placed.groupBy("column", share.alias("bin")).agg(F.min("value").alias("low"), F.max("value").alias("high")).collect():
            spans[r.column].append((r.low, r.high))
    out = []
    for own in spans:
        own.sort()
        out.append(np.array([(a[1] + b[0]) / 2 for a, b in zip(own, own[1:], strict=False)]))
    return out


@dataclass
class Layout:
    """Which features are counted together: the bundle of each, its stride there and its bins."""

    bins: list[int]
    bundle: list[int] = field(default_factory=list)
    stride: list[int] = field(default_factory=list)
    cells: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        for n in self.bins:
            at = next((b for b, c in enumerate(self.cells) if c * n <= CELLS), None)
            if at is None:
                at = len(self.cells)
                self.cells.append(1)
            self.bundle.append(at)
            self.stride.append(self.cells[at])
            self.cells[at] *= n

    def codes(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.cells), len(x)), np.uint16)
        for f, (b, s) in enumerate(zip(self.bundle, self.stride, strict=True)):
            out[b] += (x[:, f].astype(np.uint16) * np.uint16(s)).astype(np.uint16)
        return out

    def by_feature(self, sums: list[np.ndarray], nodes: int) -> np.ndarray:
        """[nodes, bins of all features] from the sums of bundles, [nodes * cells] each."""
        out = []
        for b, s, n in zip(self.bundle, self.stride, self.bins, strict=True):
            out.append(sums[b].reshape(nodes, -1, n, s).sum(axis=(1, 3)))
        return np.concatenate(out, axis=1)


class Tree:
    """Nodes as a heap: the children of i are 2i + 1 and 2i + 2. A leaf has feature -1."""

    def __init__(self, depth: int) -> None:
        n = 2 ** (depth + 1) - 1
        self.feature, self.bin = np.full(n, -1), np.zeros(n, int)
        self.value, self.rows, self.gain = np.zeros(n), np.zeros(n), np.zeros(n)

    def next_nodes(self, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
        """(bundle that a node asks, [node, code] -> next node); a leaf stays."""
        n = len(self.feature)
        asked, follow = np.zeros(n, np.int64), np.repeat(np.arange(n, dtype=np.int64)[:, None], CELLS, axis=1)
        code = np.arange(CELLS)
        for i in np.flatnonzero(self.feature >= 0):
            f = self.feature[i]
            asked[i] = layout.bundle[f]
            follow[i] = 2 * i + 1 + (code // layout.stride[f] % layout.bins[f] > self.bin[i])
        return asked, follow

    def grow(self, level: int, rows: np.ndarray, sums: np.ndarray, layout: Layout) -> bool:
        """Splits the level's nodes where that gains most, by [nodes, bins] counts and sums; whether any was split."""
        first, grown = 2**level - 1, False
        starts = np.r_[0, np.cumsum(layout.bins)]
        for at in range(2**level):
            node = first + at
            w, g = rows[at, : starts[1]].sum(), sums[at, : starts[1]].sum()
            if w <= 0 or (level and self.feature[(node - 1) // 2] < 0):
                continue
            self.value[node], self.rows[node] = g / w / SCALE, w
            best, base = (LEAST_GAIN * max(g * g / w, w), -1, -1, 0.0, 0.0), g * g / w
            for f, (a, z) in enumerate(zip(starts, starts[1:], strict=False)):
                lw, lg = np.cumsum(rows[at, a : z - 1]), np.cumsum(sums[at, a : z - 1])
                usable = np.flatnonzero((lw > 0) & (lw < w))
                if usable.size:
                    lw, lg = lw[usable], lg[usable]
                    gain = lg**2 / lw + (g - lg) ** 2 / (w - lw) - base
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (gain[k], f, int(usable[k]), lw[k], lg[k])
            gain, f, b, lw, lg = best
            if f >= 0:
                grown = True
                self.feature[node], self.bin[node], self.gain[node] = f, b, gain / w / SCALE**2
                for child, cw, cg in ((2 * node + 1, lw, lg), (2 * node + 2, w - lw, g - lg)):
                    self.value[child], self.rows[child] = cg / cw / SCALE, cw
        return grown


class Rows:
    """Counted rows of a task with their state: codes [bundles, n], outcome -1 or 1, count, hash and margin."""

    def __init__(self, codes: np.ndarray, y: np.ndarray, n: np.ndarray, h: np.ndarray) -> None:
        self.codes, self.y, self.h = codes, y.astype(np.int8), h.astype(np.uint32)
        self.n = None if not len(n) or n.max() == 1 else n.astype(float)
        self.margin = np.zeros(len(y))
        #: Of the round: count and residual of each row, as one number if all counts are one.
        self.sums: list[np.ndarray] = []

    def nodes(self, levels: int, asked: np.ndarray, follow: np.ndarray, part: slice) -> np.ndarray:
        """Where the rows are so many levels below the root."""
        codes, each = self.codes[:, part], np.arange(part.stop - part.start)
        if not levels:
            return np.zeros(len(each), np.int64)
        node = follow[0][codes[asked[0]]]
        for _ in range(levels - 1):
            node = follow.ravel()[node * CELLS + codes[asked[node], each]]
        return node

    def parts(self) -> Iterator[slice]:
        for a in range(0, len(self.y), CHUNK):
            yield slice(a, min(a + CHUNK, len(self.y)))

    def begin(self, round_: int, share: float, before: Tree | None, rate: float, layout: Layout) -> Rows:
        """After the tree `before`: margins, residuals, and the share of the rows that the round takes."""
        whole = self.n is None
        sums = [np.empty(len(self.y)) for _ in range(1 if whole else 2)]
        asked, follow = (None, None) if before is None else before.next_nodes(layout)
        for part in self.parts():
            y = self.y[part].astype(float)
            pull = y
            if before is not None:
                depth = int(np.log2(len(before.feature) + 1)) - 1
                self.margin[part] += rate * before.value[self.nodes(depth, asked, follow, part)]
                pull = 4 * y / (1 + np.exp(2 * y * self.margin[part]))
            pull = np.rint(SCALE * pull)
            n = 1.0 if whole else self.n[part]
            if share < 1:
                z = self.h[part] + np.uint32(round_ * 0x9E3779B9 & 0xFFFFFFFF)
                for shift, times in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
                    z = (z ^ (z >> np.uint32(shift))) * np.uint32(times)
                n = np.floor(n * share + z * 2.0**-32)
            if whole:
                sums[0][part] = n * (PACKED + pull)
            else:
                sums[0][part], sums[1][part] = n, n * pull
        self.sums = sums
        return self

    def histograms(self, tree: Tree, level: int, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
        """[nodes of the level, bins] counts and sums of residuals."""
        nodes, first = 2**level, 2**level - 1
        asked, follow = tree.next_nodes(layout)
        rows, sums = ([np.zeros(nodes * c) for c in layout.cells] for _ in range(2))
        for part in self.parts():
            weights = [w[part] for w in self.sums]
            at = self.nodes(level, asked, follow, part) - first
            if level:
                weights = [w * (at >= 0) for w in weights]
                np.maximum(at, 0, out=at)
            for b, cells in enumerate(layout.cells):
                index = at * cells + self.codes[b, part]
                found = [np.bincount(index, w, nodes * cells) for w in weights]
                if len(found) == 1:
                    count = np.floor(found[0] / PACKED + 0.5)
                    found = [count, found[0] - count * PACKED]
                rows[b] += found[0]
                sums[b] += found[1]
        return layout.by_feature(rows, nodes), layout.by_feature(sums, nodes)


def _boost(begin: Callable, histograms: Callable, layout: Layout, rounds: int, depth: int) -> list[Tree]:
    trees: list[Tree] = []
    for r in range(rounds):
        begin(r, trees[-1] if trees else None)
        tree = Tree(depth)
        for level in range(depth):
            if not tree.grow(level, *histograms(tree, level), layout):
                break
        trees.append(tree)
    return trees


def _rates(round_: int, rate: float) -> float:
    """The first tree counts whole."""
    return 1.0 if round_ == 0 else rate


def _binned(at: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([np.searchsorted(e, c.to_numpy(zero_copy_only=False), side="left") for e, c in zip(at, batch.columns, strict=False)], axis=1).astype(np.uint8)
            packed = pa.Array.from_buffers(pa.binary(x.shape[1]), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([packed, batch.column(batch.num_columns - 1)], ["x", "y"])

    return run


def _blocks(width: int, layout: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(-1, width), *(b.column(i).to_numpy() for i in (1, 2, 3))) for b in batches]
        if found:
            x, y, n, h = (np.concatenate(c) for c in zip(*found, strict=True))
            block = pickle.dumps(Rows(layout.codes(x), np.where(y > 0, 1, -1), n, (h & 0xFFFFFFFF).astype(np.uint32)), 5)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], ["block"])

    return run


def _filled(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0) for c in features]
    return df.where(F.col(label).isNotNull()).select(*(e.alias(f"_f{i}") for i, e in enumerate(filled)), F.col(label).cast("double").alias("_y"))


def grow_trees(df: DataFrame, features: Sequence[str], label: str, rounds: int, depth: int, rate: float, share: float) -> tuple[list[Tree], list[np.ndarray]]:
    """(trees, thresholds of each feature); features that are missing count as zero, also as whole columns."""
    rows = _filled(df, features, label)
    at = edges(rows, rows.columns[:-1])
    layout = Layout([len(e) + 1 for e in at])
    counted = settled(rows.mapInArrow(_binned(at), "x binary, y double").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.xxhash64("x", "y")))
    total = counted.count()
    if not total:
        raise ValueError("no rows to fit on")
    tasks = -(-total // BLOCK_ROWS)
    if tasks > 1:  # whole waves of tasks
        slots = df.sparkSession.sparkContext.defaultParallelism
        tasks = -(-tasks // slots) * slots
    blocks = settled(counted.repartition(tasks, "x", "y").mapInArrow(_blocks(len(features), layout), "block binary")).rdd.map(lambda r: pickle.loads(r[0]))
    if tasks == 1:
        return blocks.map(lambda own: _alone(own, layout, rounds, depth, rate, share)).collect()[0], at

    state = [blocks.persist(StorageLevel.MEMORY_AND_DISK)]

    def begin(r: int, before: Tree | None) -> None:
        step = state[-1].map(lambda own: own.begin(r, share, before, _rates(r - 1, rate), layout)).persist(StorageLevel.MEMORY_AND_DISK)
        if r and r % ROUNDS_KEPT == 0:
            step.checkpoint()
        state.append(step)

    def histograms(tree: Tree, level: int) -> tuple[np.ndarray, np.ndarray]:
        found = state[-1].map(lambda own: own.histograms(tree, level, layout)).collect()
        while len(state) > 1:
            state.pop(0).unpersist()
        return sum(f[0] for f in found), sum(f[1] for f in found)

    trees = _boost(begin, histograms, layout, rounds, depth)
    state[-1].unpersist()
    return trees, at


def _alone(own: Rows, layout: Layout, rounds: int, depth: int, rate: float, share: float) -> list[Tree]:
    return _boost(lambda r, before: own.begin(r, share, before, _rates(r - 1, rate), layout), lambda tree, level: own.histograms(tree, level, layout), layout, rounds, depth)


def _spark_model(df: DataFrame, trees: list[Tree], at: list[np.ndarray], rate: float) -> GBTClassificationModel:
    """The trees as a model of Spark's. Its nodes carry counts, values and gains; squares are not summed, so impurities are -1."""
    context = df.sparkSession.sparkContext
    gateway, spark = context._gateway, context._jvm.org.apache.spark
    leaf, inner, threshold = spark.ml.tree.LeafNode, spark.ml.tree.InternalNode, spark.ml.tree.ContinuousSplit
    calculator, span, grown_of = spark.mllib.tree.impurity.VarianceCalculator, context._jvm.java.util.Arrays.copyOfRange, spark.ml.regression.DecisionTreeRegressionModel
    named = uuid.uuid4().hex[:12]
    # Count, sum and sum of squares of all nodes go over in one piece.
    facts = np.stack([np.stack([t.rows, t.rows * t.value, t.rows * t.value**2], axis=1) for t in trees]).ravel()
    facts = spark.mllib.linalg.Vectors.parse(f"[{','.join(map(repr, facts.tolist()))}]").toArray()

    def node(t: int, i: int):
        tree = trees[t]
        at_node = 3 * (t * len(tree.value) + i)
        stats = calculator(span(facts, at_node, at_node + 3), int(tree.rows[i]))
        f, value = int(tree.feature[i]), float(tree.value[i])
        if f < 0:
            return leaf(value, -1.0, stats)
        return inner(value, -1.0, float(tree.gain[i]), node(t, 2 * i + 1), node(t, 2 * i + 2), threshold(f, float(at[f][tree.bin[i]])), stats)

    grown, weights = gateway.new_array(grown_of, len(trees)), gateway.new_array(gateway.jvm.double, len(trees))
    for t in range(len(trees)):
        grown[t] = grown_of(f"dtr_{named}_{t}", node(t, 0), len(at))
        weights[t] = _rates(t, rate)
    return GBTClassificationModel(spark.ml.classification.GBTClassificationModel(f"gbtc_{named}", grown, weights, len(at), 2))


@dataclass
class Boosted:
    """What was fitted; Spark's model of it is made when first asked for, as its nodes are made one by one."""

    trees: list[Tree]
    at: list[np.ndarray]
    rate: float
    rows: DataFrame

    @cached_property
    def leaves(self) -> Leaves:
        return Leaves.grown(self.trees, self.at, self.rate)

    @cached_property
    def model(self) -> GBTClassificationModel:
        made = _spark_model(self.rows, self.trees, self.at, self.rate)
        made._leaves = self.leaves
        return made


def boosted(df: DataFrame, features: Sequence[str], label: str, rounds: int, depth: int, rate: float, share: float) -> Boosted:
    return Boosted(*grow_trees(df, features, label, rounds, depth, rate, share), rate, df)


def fit(df: DataFrame, features: Sequence[str], label: str, rounds: int, depth: int, rate: float, share: float) -> GBTClassificationModel:
    return boosted(df, features, label, rounds, depth, rate, share).model


def scored(df: DataFrame, leaves: Leaves, features: Sequence[str], label: str) -> DataFrame:
    """(p, y) of each row with a label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for a in range(0, batch.num_rows, SCORED):
                part = batch.slice(a, SCORED)
                bins = {f: leaves.bins(f, part.column(f).to_numpy(zero_copy_only=False)) for f in range(len(features))}
                found.append(leaves.chance(leaves.left_over(bins, part.num_rows)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0), *found])), batch.column(len(features))], ["p", "y"])

    return _filled(df, features, label).mapInArrow(run, "p double, y double")


class Leaves:
    """A fitted model's leaves, as bits: `agree[f][bin]` has a bit for each leaf that a value in the bin does not rule out.

    A row's leaves are those that all its features leave over, one a tree.
    """

    def __init__(self, width: int, leaves: list[tuple[float, list[tuple[int, float, bool]]]]) -> None:
        self.value = np.array([v for v, _ in leaves])
        asked: list[set[float]] = [set() for _ in range(width)]
        for _, path in leaves:
            for f, threshold, _ in path:
                asked[f].add(threshold)
        self.edges = [np.array(sorted(a)) for a in asked]
        agree = [np.ones((len(e) + 1, len(leaves)), bool) for e in self.edges]
        for i, (_, path) in enumerate(leaves):
            for f, threshold, right in path:
                cut = int(np.searchsorted(self.edges[f], threshold)) + 1
                agree[f][slice(None, cut) if right else slice(cut, None), i] = False
        self.agree = [np.packbits(a, axis=1) for a in agree]

    @staticmethod
    def grown(trees: list[Tree], at: list[np.ndarray], rate: float) -> Leaves:
        found = []

        def walk(tree: Tree, i: int, times: float, path: list) -> None:
            f = tree.feature[i]
            if f < 0:
                found.append((times * tree.value[i], path))
                return
            for right in (False, True):
                walk(tree, 2 * i + 1 + right, times, [*path, (f, at[f][tree.bin[i]], right)])

        for t, tree in enumerate(trees):
            walk(tree, 0, _rates(t, rate), [])
        return Leaves(len(at), found)

    @staticmethod
    def of(model: GBTClassificationModel) -> Leaves:
        """Those of a model that was fitted here, or else read from its nodes."""
        if getattr(model, "_leaves", None) is None:
            found = []

            def walk(node, times: float, path: list) -> None:
                if not node.subtreeDepth():
                    found.append((times * node.prediction(), path))
                    return
                split = node.split()
                f, threshold = split.featureIndex(), split.threshold()
                walk(node.leftChild(), times, [*path, (f, threshold, False)])
                walk(node.rightChild(), times, [*path, (f, threshold, True)])

            for tree, times in zip(model.trees, model.treeWeights, strict=True):
                walk(tree._call_java("rootNode"), times, [])
            model._leaves = Leaves(model.numFeatures, found)
        return model._leaves

    def bins(self, f: int, x: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges[f], x, side="left")

    def left_over(self, bins: dict[int, np.ndarray], n: int) -> np.ndarray:
        """[n, bytes]: leaves that the bins of some features leave over."""
        out = np.full((n, self.agree[0].shape[1]), 255, np.uint8)
        for f, b in bins.items():
            if self.edges[f].size:
                out &= self.agree[f][b]
        return out

    def _bits(self, packed: np.ndarray) -> np.ndarray:
        return np.unpackbits(packed, axis=1, count=len(self.value)).astype(float)

    def chances(self, fixed: np.ndarray, moving: np.ndarray, at: np.ndarray) -> np.ndarray:
        """[n, steps] chances of rows whose features are fixed, [n, bytes], or move, [states, bytes]; `at` [n, steps] is the
        state at each step. States that rows share are met in one product of matrices."""
        n, steps = at.shape
        if len(moving) <= 8 * steps:
            margin = np.take_along_axis(self._bits(fixed) @ (self._bits(moving) * self.value).T, at, axis=1)
        else:
            margin = np.stack([self._bits(fixed & moving[at[:, t]]) @ self.value for t in range(steps)], axis=1)
        return 1 / (1 + np.exp(-2 * margin))

    def chance(self, packed: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-2 * (self._bits(packed) @ self.value)))
