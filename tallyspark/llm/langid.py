"""Language ID by multilingual mixture inference.

Every language has a unigram model over character trigrams (folded to BUCKETS classes), counted on all labelled
documents outside the held-out fold. A document is a mixture: each of its trigrams comes from one of the languages, or
from a uniform background that takes up what no language explains. Expectation-maximisation fits the proportions over
all languages; nested sets of the strongest languages are then refitted, and the set with the best penalised
likelihood is kept. The prediction is the language with the largest proportion in that set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, text_blocks

BUCKETS = 4096
UNDETERMINED = "und"
#: Share of each model that is spread evenly over all trigrams.
SMOOTHING = 0.02
ROUNDS = 12
TOLERANCE = 1e-3
#: Documents whose trigram counts a task holds at a time.
DOCUMENTS_AT_A_TIME = 512
#: Bytes whose trigrams are computed at a time; a longer text is counted in parts.
PART_BYTES = 4 << 20

#: Bytes to classes: letters without case; digits, marks and white space each as one class; other bytes as they are.
_CLASS = np.arange(256, dtype=np.uint32)
_CLASS[:128] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 1
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = np.arange(97, 123)
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def _fold(data: np.ndarray) -> np.ndarray:
    """Classes of bytes; capital two-byte Latin letters (C3 80-9E) fold to small ones."""
    out = _CLASS[data]
    if data.size > 1:
        capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1
        out[capital] += 32
    return out


def trigram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts [texts, BUCKETS] of the trigrams with a letter, inside each text; PART_BYTES of bytes are in work at a time."""
    n = offsets.size - 1
    total = np.zeros(n * BUCKETS, np.int64)
    for at in range(0, max(data.size - 2, 0), PART_BYTES):
        # One byte more before, for capitals of two bytes, and two behind, for the last trigrams.
        lead = min(at, 1)
        c = _fold(data[at - lead : at + PART_BYTES + 2])[lead:]
        h = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA77)) ^ (c[2:] * np.uint32(0xC2B2AE3D))
        h ^= h >> np.uint32(15)
        h = (h * np.uint32(0x2C1B3C6D)) >> np.uint32(20)
        letter = c > 3
        good = letter[:-2] | letter[1:-1] | letter[2:]
        doc = np.repeat(np.arange(n), np.diff(np.clip(offsets, at, at + c.size)))
        good &= doc[:-2] == doc[2:]
        total += np.bincount(doc[:-2][good] * BUCKETS + h[good], minlength=n * BUCKETS)
    return total.reshape(n, BUCKETS).astype(np.float32)


def has_letter(raw: bytes) -> bool:
    return any(map(str.isalpha, raw.decode("utf-8", "replace")))


def _letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros(offsets.size - 1, dtype=bool)
    filled = np.flatnonzero(np.diff(offsets))
    if filled.size:
        out[filled] = np.logical_or.reduceat(_ASCII_LETTER[data], offsets[filled])
    for i in np.flatnonzero(~out):
        out[i] = has_letter(data[offsets[i] : offsets[i + 1]].tobytes())
    return out


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i in range(0, offsets.size - 1, DOCUMENTS_AT_A_TIME):
        j = min(i + DOCUMENTS_AT_A_TIME, offsets.size - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for first, _, block, bounds in text_blocks(batch):
            for i, j, data, offsets in _pieces(block, bounds):
                counts = trigram_counts(data, offsets)
                own = langs[first + i : first + j]
                for lang in set(own):
                    part = counts[own == lang].sum(axis=0, dtype=np.float64)
                    totals[lang] = totals.get(lang, 0) + part
    for lang, total in totals.items():
        used = np.flatnonzero(total)
        yield pa.record_batch({"lang": pa.array([lang] * used.size, pa.string()), "gram": pa.array(used.astype(np.int32)), "n": pa.array(total[used].astype(np.int64))})


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in code point order and their trigram probabilities [languages + 1, BUCKETS]; the last is uniform.

    Counts cover all given rows with a text and a language. What reaches the driver is one number for each language
    and trigram class.
    """
    rows = docs.where("lang is not null and text is not null").select("lang", "text")
    counted = rows.mapInArrow(_count_rows, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r.lang for r in counted})
    model = np.zeros((len(langs) + 1, BUCKETS))
    at = {lang: i for i, lang in enumerate(langs)}
    for r in counted:
        model[at[r.lang], r.gram] = r.n
    sums = model.sum(axis=1, keepdims=True)
    model = (1 - SMOOTHING) * np.divide(model, sums, out=np.full_like(model, 1 / BUCKETS), where=sums > 0) + SMOOTHING / BUCKETS
    return langs, model.astype(np.float32)


def _mix(counts: np.ndarray, model: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after EM from `weights` (zero stays zero) and the log-likelihoods, for each text."""
    weights = weights.astype(np.float32)
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    active = np.arange(counts.shape[0])
    for _ in range(ROUNDS):
        w = weights[active]
        fit = counts[active]
        np.divide(fit, np.maximum(w @ model, 1e-12), out=fit)
        new = w * (fit @ model.T) / total[active]
        new /= np.maximum(new.sum(axis=1, keepdims=True), 1e-12)
        weights[active] = new
        active = active[np.abs(new - w).max(axis=1) > TOLERANCE]
        if active.size == 0:
            break
    likelihood = np.einsum("ij,ij->i", counts, np.log(np.maximum(weights @ model, 1e-12)))
    return weights, likelihood


def infer(counts: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(proportions [texts, languages], evidence per trigram over the uniform background).

    The evidence is that of the chosen set's fitted mixture less its penalty, or of the top language alone if larger.
    """
    n, k = counts.shape[0], model.shape[0] - 1
    total = counts.sum(axis=1)
    logs = np.log(model)
    single = counts @ logs.T
    start = np.full((n, k + 1), 1 / (k + 1))
    full, _ = _mix(counts, model, start)
    order = np.argsort(-full[:, :k], axis=1, kind="stable")
    rows = np.arange(n)
    penalty = 0.5 * np.log(np.maximum(total, 2))
    # Sets of one language are fitted with the background; larger nested sets follow as long as they pay.
    best = np.zeros((n, k + 1), np.float32)
    score = np.full(n, -np.inf)
    open_rows = rows
    for size in range(1, k + 1):
        allowed = np.zeros((open_rows.size, k + 1))
        np.put_along_axis(allowed, order[open_rows, :size], 1.0, axis=1)
        begin = allowed * np.maximum(full[open_rows], 1e-3)
        begin[:, k] = np.maximum(full[open_rows, k], 1e-3)
        begin /= begin.sum(axis=1, keepdims=True)
        weights, likelihood = _mix(counts[open_rows], model, begin)
        value = likelihood - penalty[open_rows] * size
        better = value > score[open_rows]
        won = open_rows[better]
        best[won], score[won] = weights[better], value[better]
        open_rows = won
        if won.size == 0:
            break
    share = best[:, :k]
    share = share / np.maximum(share.sum(axis=1, keepdims=True), 1e-12)
    alone = np.take_along_axis(single, order[:, :1], axis=1)[:, 0]
    evidence = (np.maximum(score, alone) - single[:, k]) / np.maximum(total, 1)
    return share, evidence


def _predict_rows(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, model = shared.value
        for batch in batches:
            predicted, scores, evidence, mixtures = [], [], [], []
            for _, _, block, bounds in text_blocks(batch):
                letters = _letters(block, bounds)
                for i, j, data, offsets in _pieces(block, bounds):
                    if not langs:
                        predicted += [UNDETERMINED] * (j - i)
                        scores += [0.0] * (j - i)
                        evidence += [0.0] * (j - i)
                        mixtures += [""] * (j - i)
                        continue
                    share, proof = infer(trigram_counts(data, offsets), model)
                    top = share.argmax(axis=1)
                    for r in range(j - i):
                        known = bool(letters[i + r])
                        predicted.append(langs[top[r]] if known else UNDETERMINED)
                        scores.append(min(1.0, float(share[r, top[r]])) if known else 0.0)
                        evidence.append(float(proof[r]) if known else 0.0)
                        mixtures.append(" ".join(f"{langs[x]}:{share[r, x]:.2f}" for x in np.flatnonzero(share[r] >= 0.005)) if known else "")
            kept = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.record_batch([*kept, pa.array(predicted, pa.string()), pa.array(scores, pa.float64()), pa.array(evidence, pa.float64()), pa.array(mixtures, pa.string())], names=[*batch.schema.names, "lang_pred", "score", "evidence", "mixture"])

    return rows


ADDED = "lang_pred string, score double, evidence double, mixture string"


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], schema: T.StructType) -> DataFrame:
    """The rows of `docs` (with a column text; `schema` is theirs) and ADDED: the language, its share of the text
    (0 to 1), the evidence per trigram against the background, and the mixture. `und` with score zero: a null text,
    one without a letter, or a model without languages. A text with letters but no trigram goes to the first language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_predict_rows(shared), T.StructType([*schema.fields, *T.StructType.fromDDL(ADDED).fields]))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, evidence, mixture) for each row of `docs` (doc_id, text, lang).

    Learns from rows with a lang whose id is not in the held-out fold; a null id is never learned from and counts as
    not held out. lang, source and doc_id are no inputs of a prediction. Null and empty texts are `und` with score 0;
    texts are read whole, whatever their length; equal likelihoods go to the first language in code point order; repeated
    rows each get a row; an empty table gives an empty one; other columns are ignored, whatever their names.
    """
    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    model = learn(picked.where(~held_out() & F.col("doc_id").isNotNull()))
    texts = picked.select("doc_id", held_out().alias("held_out"), "text")
    return predict(texts, model, T.StructType.fromDDL("doc_id long, held_out boolean, text string")).drop("text")


def known_languages(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose language can be told, with a missing lang filled in.

    A row goes if its text has no letter, or if the uniform background alone explains it better than any language or
    mixture does. A text with letters but no trigram stays. Repeated rows stay; an empty table gives an empty one; other
    columns keep their names and values, whatever they are.
    """
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("doc_id").alias("doc_id"))
    model = learn(packed.where(~held_out() & F.col("doc_id").isNotNull()))
    found = predict(packed.select("row", "text"), model, T.StructType([packed.schema["row"], T.StructField("text", T.StringType())]))
    kept = found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("evidence") >= 0))
    return kept.select(F.col("row").withField("lang", F.coalesce("row.lang", "lang_pred")).alias("row")).select("row.*")


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """identify() over all of `documents`; its edge cases hold."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
