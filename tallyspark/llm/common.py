"""Shared pieces of the training-data operators: input, blocks of text, word hashes."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A null doc_id orders after every other one.
NULL_ID = 2**63 - 1
#: Bytes of text that a task holds as numpy arrays at a time (a longer text makes a block of its own).
BLOCK_BYTES = 2 << 20

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
#: True for the bytes that are no part of a word.
SEPARATORS = _SEPARATOR


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, which driver and executors share: the session's spark.checkpoint.dir.

    Where it is unset, a local session gets a folder of its own; on a cluster that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the session's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id's decimal text leaves 2 modulo 4; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def text_blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets from 0) of runs of rows with about `limit` bytes; null is empty."""
    array = batch.column(batch.schema.get_field_index(column))
    if array.null_count:
        array = pc.fill_null(array, "")
    wide = pa.types.is_large_string(array.type)
    _, offset_buffer, data_buffer = array.buffers()
    n = len(array)
    offsets = np.frombuffer(offset_buffer, dtype=np.int64 if wide else np.int32)[array.offset : array.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None and data_buffer.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(n, max(first + 1, end))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every `[^\\x20\\x09-\\x0D]+` word, and each text's first word (with an end)."""
    n = data.size
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(offsets.size, np.int64)
    separator = _SEPARATOR[data]
    bounds = offsets[(offsets > 0) & (offsets < n)]
    before = np.empty(n, dtype=bool)
    before[0] = True
    before[1:] = separator[:-1]
    before[bounds] = True
    after = np.empty(n, dtype=bool)
    after[-1] = True
    after[:-1] = separator[1:]
    after[bounds - 1] = True
    np.logical_not(separator, out=separator)
    start = np.flatnonzero(separator & before)
    end = np.flatnonzero(separator & after) + 1
    return start, end, np.searchsorted(start, offsets)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_LONG_WORD = 256
_CHUNK_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes: eight bytes at a time are mixed in; words beyond _LONG_WORD bytes get XXH64."""
    h = mix64((end - start).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (seed + 1) % 2**64))
    if start.size == 0:
        return h
    padded = np.zeros(data.size + 8, np.uint8)
    padded[: data.size] = data
    eights = np.ndarray((data.size + 1,), "<u8", padded, strides=(1,))
    sizes = end - start
    open_words, at = np.flatnonzero(sizes <= _LONG_WORD), 0
    while open_words.size:
        chunk = eights[start[open_words] + at] & _CHUNK_MASKS[np.minimum(sizes[open_words] - at, 8)]
        h[open_words] = mix64((h[open_words] ^ chunk) + np.uint64(0xD1342543DE82EF95))
        at += 8
        open_words = open_words[sizes[open_words] > at]
    for i in np.flatnonzero(sizes > _LONG_WORD).tolist():
        h[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes(), seed + 1)
    return h


def _joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hashes of two parts in this order."""
    return mix64((x * np.uint64(0x9FB21C651E98DF25)) ^ (mix64(y) + np.uint64(0x2545F4914F6CDD1D)))


def run_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of `width` values, joined from runs of powers of two."""
    out, taken, power, level = None, 0, 1, values
    while True:
        if width & power:
            out = level if out is None else _joined(out[: level.size - taken], level[taken:]) if level.size > taken else level[:0]
            taken += power
        if power * 2 > width:
            return out if out is not None else values[:0]
        level = _joined(level[:-power], level[power:]) if level.size > power else level[:0]
        power *= 2


def text_parts(batch: pa.RecordBatch, overlap: int, limit: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, words before, UTF-8 bytes, offsets) like text_blocks, but long texts come in parts of about `limit` bytes
    that end between words and repeat the last `overlap` words of the part before."""
    for first, end, data, offsets in text_blocks(batch, limit=limit):
        if data.size <= 2 * limit:
            yield np.arange(first, end), np.zeros(end - first, np.int64), data, offsets
            continue
        at = before = 0
        reach = limit
        while True:
            stop = min(data.size, at + reach)
            while stop < data.size and not _SEPARATOR[data[stop]]:
                ahead = np.flatnonzero(_SEPARATOR[data[stop : stop + 65536]])
                stop = stop + int(ahead[0]) if ahead.size else min(data.size, stop + 65536)
            part = data[at:stop]
            start, _, _ = words_of(part, np.array([0, part.size]))
            if stop < data.size and start.size <= overlap:
                reach *= 2
                continue
            yield np.array([first]), np.array([before]), part, np.array([0, part.size])
            if stop == data.size:
                break
            before += start.size - overlap
            at += int(start[start.size - overlap]) if overlap else part.size
            reach = limit


def single_spaced(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with one space for each run of separators, and where each word starts in them."""
    separator = _SEPARATOR[data]
    dropped = separator.copy()
    dropped[1:] &= separator[:-1]
    at = start - np.searchsorted(np.flatnonzero(dropped), start)
    np.logical_not(dropped, out=dropped)
    out = data[dropped]
    out[separator[dropped]] = 32
    return out, at
