"""Quality classifier: ridge regression on random Fourier features, with isotonic calibration.

Whole texts become document statistics. Random Fourier features approximate a Gaussian kernel over the standardised
statistics; each task sums its rows' normal equations, and Spark sums these in groups, so only a few matrices of fixed
size reach the driver. The ridge scores of a fold that the regression has not seen are calibrated by isotonic
regression on counts in fixed score bins. Labels are read from all rows outside the held-out fold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, checkpointed, held_out, text_blocks, word_hashes, words_of

FEATURES = 192
LENGTH_SCALE = 3.0
RIDGE = 1e-3
SEED = 11
#: The matrices that reach the driver, whatever the number of tasks.
SUM_GROUPS = 8
BINS = 256
#: crc32 of the id modulo 4 of the rows that calibrate; 2 is the held-out fold, the others fit.
CALIBRATION_FOLD = 3
THRESHOLD = 0.7
#: Longer texts (bytes) are read in parts of PART_BYTES.
LONG_TEXT = 4 << 20
PART_BYTES = 2 << 20

STATISTICS = (
    "log_bytes", "log_words", "mean_word", "upper", "lower", "digit", "space", "newline", "non_ascii", "comma", "stop",
    "exclamation", "pipe", "other_mark", "entropy", "distinct_words", "top_word", "repeated_next", "short_words",
    "long_words", "marked_words", "words_a_line", "distinct_lines",
)

_GROUP = np.full(256, 10, np.int64)
_GROUP[65:91], _GROUP[97:123], _GROUP[48:58], _GROUP[128:] = 0, 1, 2, 5
_GROUP[[9, 11, 12, 13, 32]], _GROUP[10] = 3, 4
for _mark, _kind in ((",", 6), (".", 7), ("?", 7), ("!", 8), ("|", 9)):
    _GROUP[ord(_mark)] = _kind


def _shares_of_runs(doc: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text, its number of distinct values and the count of the most frequent one."""
    distinct, top = np.zeros(n), np.zeros(n)
    if doc.size:
        order = np.lexsort((value, doc))
        d, v = doc[order], value[order]
        first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (v[1:] != v[:-1])])
        size = np.diff(np.r_[first, d.size])
        distinct = np.bincount(d[first], minlength=n).astype(float)
        np.maximum.at(top, d[first], size)
    return distinct, top


def _columns(groups: np.ndarray, entropy: np.ndarray, word: dict[str, np.ndarray], distinct_lines: np.ndarray) -> np.ndarray:
    """[texts, STATISTICS] from bytes by group, entropies, sums over words, and numbers of distinct lines."""
    size, words, lines = groups.sum(axis=1), word["n"], groups[:, 4] + 1
    share, w = groups / np.maximum(size, 1)[:, None], np.maximum(words, 1)
    columns = [
        np.log1p(size), np.log1p(words), word["bytes"] / w, *share.T, entropy, word["distinct"] / w, word["top"] / w, word["same"] / w,
        word["short"] / w, word["long"] / w, word["marked"] / w, np.minimum(words / lines, 200), distinct_lines / lines,
    ]
    return np.stack(columns, axis=1)


def _entropy(histogram: np.ndarray) -> np.ndarray:
    share = histogram / np.maximum(histogram.sum(axis=1, keepdims=True), 1)
    return -(share * np.log(np.maximum(share, 1e-12))).sum(axis=1)


def _cuts(data: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    """`data` in parts of about PART_BYTES, cut behind bytes for which `ends` is true."""
    at = 0
    while at < data.size:
        stop = min(data.size, at + PART_BYTES)
        while stop < data.size and not ends[data[stop - 1]]:
            ahead = np.flatnonzero(ends[data[stop : stop + PART_BYTES]])
            stop = min(data.size, stop + (int(ahead[0]) + 1 if ahead.size else PART_BYTES))
        yield data[at:stop]
        at = stop


class _Tally:
    """Numbers of equal hashes, kept as one sorted run and the runs added since."""

    def __init__(self) -> None:
        self.runs: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]

    def add(self, hashes: np.ndarray) -> None:
        self.runs.append(np.unique(hashes, return_counts=True))
        if sum(v.size for v, _ in self.runs[1:]) > self.runs[0][0].size:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        values, at = np.unique(np.concatenate([v for v, _ in self.runs]), return_inverse=True)
        counts = np.zeros(values.size, np.int64)
        np.add.at(counts, at, np.concatenate([c for _, c in self.runs]))
        self.runs = [(values, counts)]
        return self.runs[0]


def _long_statistics(data: np.ndarray) -> np.ndarray:
    """statistics() of one long text, read in parts: what grows with it is the number of distinct words and lines."""
    histogram = sum(np.bincount(part, minlength=256) for part in _cuts(data, np.ones(256, bool)))
    groups = np.bincount(_GROUP, weights=histogram, minlength=11)
    word = dict.fromkeys(("n", "bytes", "same", "short", "long", "marked"), 0)
    seen, before = _Tally(), np.zeros(0, np.uint64)
    for part in _cuts(data, SEPARATORS):
        start, end, _ = words_of(part, np.array([0, part.size]))
        if start.size == 0:
            continue
        length, hashes = end - start, word_hashes(part, start, end)
        row = np.r_[before, hashes]
        added = (start.size, length.sum(), (row[1:] == row[:-1]).sum(), (length <= 3).sum(), (length >= 12).sum(), (_GROUP[part[end - 1]] >= 8).sum())
        for name, more in zip(word, added, strict=True):
            word[name] += int(more)
        seen.add(hashes)
        before = hashes[-1:]
    _, counts = seen.merge()
    word["distinct"], word["top"] = counts.size, counts.max(initial=0)
    lines = _Tally()
    for part in _cuts(data, np.arange(256) == 10):
        newline = np.flatnonzero(part == 10)
        end = newline if newline.size and newline[-1] == part.size - 1 else np.r_[newline, part.size]
        lines.add(word_hashes(part, np.r_[0, newline + 1][: end.size], end))
    return _columns(groups[None], _entropy(histogram[None]), {k: np.array([float(v)]) for k, v in word.items()}, np.array([float(lines.merge()[0].size)]))


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """[texts, STATISTICS] of whole texts; an empty text has zeros. A text beyond LONG_TEXT comes alone and in parts."""
    n = offsets.size - 1
    if n == 1 and data.size > LONG_TEXT:
        return _long_statistics(data)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    groups = np.bincount(doc * 11 + _GROUP[data], minlength=n * 11).reshape(n, 11)
    histogram = np.bincount(doc * 256 + data, minlength=n * 256).reshape(n, 256)
    start, end, bounds = words_of(data, offsets)
    word_doc = np.repeat(np.arange(n), np.diff(bounds))
    length = end - start
    hashes = word_hashes(data, start, end)
    distinct, top = _shares_of_runs(word_doc, hashes, n)
    same = (hashes[1:] == hashes[:-1]) & (word_doc[1:] == word_doc[:-1])
    total = lambda x: np.bincount(word_doc, weights=x, minlength=n)
    last = data[end - 1] if end.size else np.zeros(0, np.uint8)
    word = {
        "n": np.diff(bounds), "bytes": total(length), "same": np.bincount(word_doc[1:][same], minlength=n), "short": total(length <= 3),
        "long": total(length >= 12), "marked": total(_GROUP[last] >= 8), "distinct": distinct, "top": top,
    }
    # Lines end at newlines, which are no part of them, and at the ends of texts.
    newline = data == 10
    line_first = np.flatnonzero(np.r_[True, newline[:-1] | (doc[1:] != doc[:-1])]) if data.size else np.zeros(0, np.int64)
    line_end = np.r_[line_first[1:], data.size] if data.size else line_first
    line_end = line_end - newline[line_end - 1]
    distinct_lines, _ = _shares_of_runs(doc[line_first], word_hashes(data, line_first, line_end), n)
    return _columns(groups, _entropy(histogram), word, distinct_lines)


def _statistics_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.float64())
    for batch in batches:
        rows = [statistics(data, offsets) for _, _, data, offsets in text_blocks(batch)]
        x = np.concatenate(rows) if rows else np.zeros((0, len(STATISTICS)))
        offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(STATISTICS))
        keep = [n for n in batch.schema.names if n != "text"]
        yield pa.record_batch([*(batch.column(n) for n in keep), pa.ListArray.from_arrays(offsets, pa.array(x.ravel())).cast(kind)], names=[*keep, "x"])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        directions = rng.normal(0, 1 / LENGTH_SCALE, (len(STATISTICS), FEATURES))
        phase = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(z @ directions + phase), np.ones((len(x), 1))], axis=1)

    def ridge(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.ridge(x), self.knots, self.values), 0, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), len(STATISTICS))


def _equation_rows(model: Model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            if len(batch):
                f = model.features(_matrix(batch.column("x")))
                y = batch.column("y").to_numpy()
                total += f.T @ np.concatenate([f, y[:, None]], axis=1)
        group = TaskContext.get().partitionId() % SUM_GROUPS
        yield pa.record_batch({"g": pa.array([group], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    return rows


def _sum_group(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = 0
    for batch in batches:
        for value in batch.column("sums"):
            total = total + np.frombuffer(value.as_buffer(), np.float64)
    yield pa.record_batch({"g": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


def _bin_rows(model: Model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, BINS))
        for batch in batches:
            if len(batch):
                r = model.ridge(_matrix(batch.column("x")))
                b = np.clip(((r + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
                for k, v in enumerate((np.ones_like(r), batch.column("y").to_numpy(), r)):
                    sums[k] += np.bincount(b, weights=v, minlength=BINS)
        used = np.flatnonzero(sums[0])
        yield pa.record_batch({"b": pa.array(used.astype(np.int32)), "n": pa.array(sums[0][used]), "y": pa.array(sums[1][used]), "r": pa.array(sums[2][used])})

    return rows


def pool(n: np.ndarray, y: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of bins in score order: (mean score, mean label) of each pooled block."""
    blocks: list[list[float]] = []
    for block in zip(n, y, r, strict=True):
        blocks.append(list(block))
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks).reshape(-1, 3)
    return b[:, 2] / b[:, 0], b[:, 1] / b[:, 0]


def fit(labelled: DataFrame) -> Model:
    """A model from a table (x, y double, calibrates boolean). Without rows every score is one half."""
    k = len(STATISTICS)
    moments = labelled.select(*(f(F.col("x")[i]).alias(f"{name}_{i}") for i in range(k) for name, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    mean = np.array([moments[f"m_{i}"] or 0.0 for i in range(k)])
    scale = np.maximum(np.array([moments[f"s_{i}"] or 0.0 for i in range(k)]), 1e-3)
    model = Model(mean, scale, np.r_[np.zeros(FEATURES), 0.5], np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    parts = labelled.where("not calibrates").select("x", "y").mapInArrow(_equation_rows(model), "g int, sums binary")
    sums = sum(np.frombuffer(r.sums, np.float64) for r in parts.groupBy("g").applyInArrow(_sum_group, "g int, sums binary").collect())
    if np.ndim(sums) and sums.reshape(FEATURES + 1, -1)[FEATURES, FEATURES] > 0:
        sums = sums.reshape(FEATURES + 1, FEATURES + 2)
        gram, target = sums[:, :-1], sums[:, -1]
        penalty = np.eye(FEATURES + 1) * RIDGE * gram[FEATURES, FEATURES]
        penalty[FEATURES, FEATURES] = 0
        model.weights = np.linalg.solve(gram + penalty, target)
        bins = labelled.where("calibrates").select("x", "y").mapInArrow(_bin_rows(model), "b int, n double, y double, r double").groupBy("b").agg(F.sum("n").alias("n"), F.sum("y").alias("y"), F.sum("r").alias("r")).collect()
        if bins:
            bins.sort(key=lambda r: r.b)
            model.knots, model.values = pool(*(np.array([r[c] for r in bins]) for c in ("n", "y", "r")))
        else:
            model.values = np.array([0.0, 1.0])
    return model


def _score_rows(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(_matrix(batch.column("x"))) if len(batch) else np.zeros(0)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": pa.array(score), "predicted": pa.array((score >= THRESHOLD).astype(np.int32))})

    return rows


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of `docs` (doc_id, text), learned from `labels` (doc_id, quality).

    Rows of the held-out fold and those with a null id or label are not learned from; repeated labels count each. A
    null text counts as empty, and has a score. Without any labels every score is one half. Texts are read whole; repeated
    rows each get a row; an empty table gives an empty one; other columns are ignored, whatever their names.
    """
    picked = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    stats = checkpointed(picked.mapInArrow(_statistics_rows, "doc_id long, held_out boolean, x array<double>"))
    marks = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("double").alias("y"))
    calibrates = F.pmod(F.crc32(F.col("label_id").cast("string")), F.lit(4)) == CALIBRATION_FOLD
    labelled = stats.where(~F.col("held_out")).join(marks, F.col("doc_id") == F.col("label_id")).select("x", "y", calibrates.alias("calibrates"))
    model = fit(checkpointed(labelled))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return stats.mapInArrow(_score_rows(shared), "doc_id long, held_out boolean, score double, predicted int")


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """score_quality() of all `documents` by `labels`; its edge cases hold."""
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
