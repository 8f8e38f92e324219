"""Substring dedup on a compacted De Bruijn graph of token k-mers.

Edges of the graph are windows of WINDOW words; consecutive windows of a text meet in the node of the words they share.

1. Edges leave the mappers in pieces: runs of consecutive windows with one minimizer, the smallest hash among their runs
   of MINIMIZER words. Equal windows have equal minimizers, so all copies of an edge lie in pieces of one minimizer; a
   piece is about seven edges long. A piece that its own document has before takes that as its source at once.
2. Pieces are dealt by minimizer and sorted by content and source coordinate (document, word). A piece that is not at
   the first coordinate of its content is repeated as a whole and takes that coordinate as its source. Where pieces of
   one minimizer differ the graph branches, and only there first pieces are opened into single edges, which find their
   sources alike, by content.
3. Paths compact: a repeated piece or edge is joined to the next one of its document if the sources are neighbours too,
   that is, if the path goes on without a branch at both of its coordinates. All repeated pieces of a path lie in one
   document on either side, so one sort by coordinate merges a path of any length, without rounds of joins.
4. Every long repeated span is verified at its source: the source document sends the SHA-256 of the words there, the
   repeating document compares it with its own, and only then its words go. A window without a source is the first of
   its hash and so the first of its content. If any span differs (a collision of hashes), all is done again with
   other hashes, so what is returned never rests on a hash of words or windows.

A minimizer in very many places would be one large group. Such heavy minimizers are counted first, over all texts; they
are few (at most HEAVY_SHARE). They count as branching and are dealt by content instead, and equal contents within a
block of text point to the first one there, so a passage in very many documents costs one row for each block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, checkpointed, mix64, run_hashes, single_spaced, text_blocks, text_parts, word_hashes, words_of

WINDOW = 20
MINIMIZER = 6
#: Ids with several texts or rows that are broadcast at most; more of them are joined by a shuffle.
SHARED_IDS = 20_000
#: A minimizer is heavy with this share of all pieces, and HEAVY_LEAST pieces; so at most so many are broadcast.
HEAVY_SHARE = 1 << 16
HEAVY_LEAST = 1024
HEAVY_SALTS = 64
_HEAVY_HELD = 1 << 21
#: Bits of the hashes of each attempt.
ATTEMPTS = (64,) * 8
#: A piece's place and length in one number.
_LENGTH_BITS = 8


class Pieces:
    """Runs of windows with one minimizer in a block of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, gram: int, seed: int, bits: int) -> None:
        start, end, bounds = words_of(data, offsets)
        n = start.size
        doc_of = np.repeat(np.arange(bounds.size - 1), np.diff(bounds))
        inside = np.flatnonzero(doc_of[: n - window + 1] == doc_of[window - 1 :]) if n >= window else np.zeros(0, np.int64)
        if inside.size == 0:
            self.doc = self.place = self.count = np.zeros(0, np.int64)
            self.key = self.content = np.zeros(0, np.uint64)
            return
        words = word_hashes(data, start, end, seed)
        mask = np.uint64((1 << bits) - 1)
        grams, windows = run_hashes(words, gram) & mask, run_hashes(words, window)
        reach, least = 1, np.arange(grams.size)
        while reach * 2 <= window - gram + 1:
            a, b = least[:-reach], least[reach:]
            least = np.where(grams[b] < grams[a], b, a)
            reach *= 2
        if rest := window - gram + 1 - reach:
            a, b = least[:-rest], least[rest:]
            least = np.where(grams[b] < grams[a], b, a)
        chosen = least[inside]
        # A piece is as long as its first and last window overlap or meet, and as its length has bits.
        most = min(window, (1 << _LENGTH_BITS) - 1)
        new = np.r_[True, (chosen[1:] != chosen[:-1]) | (inside[1:] != inside[:-1] + 1)]
        run = np.flatnonzero(new)
        new |= (np.arange(inside.size) - np.repeat(run, np.diff(np.r_[run, inside.size]))) % most == 0
        new = np.flatnonzero(new)
        first = inside[new]
        self.count = np.diff(np.r_[new, inside.size])
        self.doc = doc_of[first]
        self.place = first - bounds[self.doc]
        self.key = grams[chosen[new]]
        shape = mix64((self.count * (window + 1) + chosen[new] - first).astype(np.uint64))
        self.content = mix64(windows[first] ^ mix64(windows[first + self.count - 1] + shape)) & mask


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


_SOURCE = "sd long, sv long, sp int, n int"
#: Copies of an edge in one block from which on they point to the first one there.
MANY = 4


def _located(hashes: tuple[np.ndarray, np.ndarray], doc: np.ndarray, p: np.ndarray, n: np.ndarray, ids: np.ndarray, variants: np.ndarray, hot: np.ndarray | None) -> pa.RecordBatch:
    """Rows (k, t, d, v, p, sd, sv, sp, n) for a block's pieces or edges, which come in order.

    What repeats an earlier one of its own document has the nearest as its source; runs that go on at both places are one
    row. Of the others, hot ones (null: those with MANY copies here) have the first copy in the block as their source.
    Rows with a source get hashes of their own.
    """
    joint = mix64(hashes[0] ^ mix64(hashes[1]))
    own = mix64(joint + doc.astype(np.uint64))
    order = np.argsort(own, kind="stable")
    source = np.full(own.size, -1)
    same = own[order[1:]] == own[order[:-1]]
    source[order[1:][same]] = order[:-1][same]
    again = np.flatnonzero(source >= 0)
    goes_on = (doc[again[1:]] == doc[again[:-1]]) & (p[again[1:]] == p[again[:-1]] + n[again[:-1]]) & (p[source[again[1:]]] - p[source[again[:-1]]] == p[again[1:]] - p[again[:-1]])
    run = np.flatnonzero(np.r_[True, ~goes_on]) if again.size else again
    length = n.copy()
    length[again[run]] = np.add.reduceat(n[again], run) if again.size else 0
    d, v = ids[doc], variants[doc]
    rest = np.flatnonzero(source < 0)
    order = rest[np.lexsort((p[rest], v[rest], d[rest], joint[rest]))]
    head = np.flatnonzero(np.r_[True, joint[order[1:]] != joint[order[:-1]]]) if order.size else order
    size = np.diff(np.r_[head, order.size])
    first = np.repeat(order[head], size)
    pointed = (hot[order] if hot is not None else np.repeat(size >= MANY, size)) & (first != order)
    source[order[pointed]] = first[pointed]
    rows = np.sort(np.r_[again[run], rest])
    source, d_row, v_row, p_row = source[rows], d[rows], v[rows], p[rows]
    plain = source < 0
    apart = mix64(d_row.view(np.uint64) ^ mix64(v_row.view(np.uint64) + p_row.astype(np.uint64)))
    return pa.record_batch({
        "k": _signed(np.where(plain, hashes[0][rows], apart)), "t": _signed(np.where(plain, hashes[1][rows], mix64(apart))),
        "d": pa.array(d_row), "v": pa.array(v_row), "p": pa.array(p_row.astype(np.int32)),
        "sd": pa.array(d[source], mask=plain), "sv": pa.array(v[source], mask=plain), "sp": pa.array(p[source].astype(np.int32), mask=plain),
        "n": pa.array(length[rows].astype(np.int32)),
    })


def _piece_rows(window: int, gram: int, seed: int, bits: int, heavy: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, variants = batch.column("d").to_numpy(), batch.column("v").to_numpy()
            for of, before, data, offsets in text_parts(batch, window - 1):
                x = Pieces(data, offsets, window, gram, seed, bits)
                yield _located((x.key, x.content), of[x.doc], before[x.doc] + x.place, x.count, ids, variants, np.isin(x.key, heavy))

    return rows


def _heavy_rows(window: int, gram: int, seed: int, bits: int):
    """(k, n): minimizers with a notable number of a task's pieces, distinct in each document; k null: all pieces."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        parts: list[np.ndarray] = []

        def merge() -> None:
            nonlocal held, counts, parts
            keys, n = np.unique(np.concatenate([held, *parts]), return_inverse=True)
            held, counts, parts = keys, np.bincount(n, np.r_[counts, np.ones(n.size - counts.size, np.int64)], keys.size).astype(np.int64), []

        for batch in batches:
            for of, _, data, offsets in text_parts(batch, window - 1):
                x = Pieces(data, offsets, window, gram, seed, bits)
                distinct = x.key[np.unique(mix64(mix64(x.key ^ mix64(x.content)) + of[x.doc].astype(np.uint64)), return_index=True)[1]]
                total += distinct.size
                parts.append(distinct)
                if sum(map(len, parts)) > _HEAVY_HELD:
                    merge()
                    held, counts = held[counts > 1], counts[counts > 1]
        merge()
        notable = counts >= max(8, total // HEAVY_SHARE)
        yield pa.record_batch({"k": pa.concat_arrays([_signed(held[notable]), pa.nulls(1, pa.int64())]), "n": pa.array(np.r_[counts[notable], total])})

    return rows


def _edge_rows(window: int, seed: int, bits: int):
    """The edges of the pieces in `opened`."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.uint64((1 << bits) - 1)
        for batch in batches:
            ids, variants, opened = batch.column("d").to_numpy(), batch.column("v").to_numpy(), batch.column("opened")
            for of, before, data, offsets in text_parts(batch, window - 1):
                start, end, bounds = words_of(data, offsets)
                ats, docs = [], []
                for i, row in enumerate(of.tolist()):
                    pieces = np.sort(opened[row].values.to_numpy())
                    first, count = (pieces >> _LENGTH_BITS) - before[i], pieces & ((1 << _LENGTH_BITS) - 1)
                    at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
                    at = at[(at >= 0) & (at < bounds[i + 1] - bounds[i] - window + 1)]
                    ats.append(bounds[i] + at)
                    docs.append(np.full(at.size, i))
                at, doc = np.concatenate(ats), np.concatenate(docs)
                if at.size == 0:
                    continue
                a = run_hashes(word_hashes(data, start, end, seed), window)[at] & mask
                b = run_hashes(word_hashes(data, start, end, seed + 1000), window)[at] & mask
                yield _located((a, b), of[doc], before[doc] + at - bounds[doc], np.ones(at.size, np.int64), ids, variants, None)

    return rows


def _digest_rows(window: int):
    """(sd, sv, sp, n, digest): SHA-256 of the words of each of the spans that other documents ask for."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column("asked")
            out: dict[str, list] = {"sp": [], "n": [], "digest": []}
            rows_of = []
            for first, end, data, offsets in text_blocks(batch):
                text = Words(data, offsets)
                for i in range(end - first):
                    spans = asked[first + i].values.to_numpy()
                    places, counts = spans >> 32, spans & (2**32 - 1)
                    rows_of.append(np.full(spans.size, first + i))
                    out["sp"].append(places)
                    out["n"].append(counts)
                    out["digest"] += [text.digest(i, p, p + n + window - 1) for p, n in zip(places.tolist(), counts.tolist(), strict=True)]
            if rows_of:
                row = np.concatenate(rows_of)
                yield pa.record_batch({
                    "sd": pa.array(batch.column("d").to_numpy()[row]), "sv": pa.array(batch.column("v").to_numpy()[row]),
                    "sp": pa.array(np.concatenate(out["sp"]).astype(np.int32)), "n": pa.array(np.concatenate(out["n"]).astype(np.int64)), "digest": pa.array(out["digest"], pa.binary()),
                })

    return rows


class Words:
    """The words of a block of texts, joined by one space."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.start, self.end, self.bounds = words_of(data, offsets)
        self.joined, self.at = single_spaced(data, self.start)
        self.until = self.at + (self.end - self.start)

    def count(self, doc: int) -> int:
        return int(self.bounds[doc + 1] - self.bounds[doc])

    def digest(self, doc: int, first: int, end: int) -> bytes:
        a, b = self.bounds[doc] + first, self.bounds[doc] + end
        return hashlib.sha256(self.joined[self.at[a] : self.until[b - 1]]).digest() if b <= self.bounds[doc + 1] else b""

    def kept(self, doc: int, covered: np.ndarray) -> bytes:
        a, b = self.bounds[doc], self.bounds[doc + 1]
        if a == b:
            return b""
        low, high = self.at[a], self.until[b - 1]
        own = self.joined[low:high]
        edge = np.flatnonzero(np.diff(np.r_[False, covered, False].astype(np.int8))).reshape(-1, 2)
        if edge.size == 0:
            return own.tobytes()
        parts, last = [], low
        for first, end in edge.tolist():
            parts.append(self.joined[last : self.at[a + first]])
            last = self.at[a + end] if a + end < b else high
        parts.append(self.joined[last:high])
        return np.concatenate(parts).tobytes().rstrip(b" ")


def _written(covered: np.ndarray) -> str:
    edge = np.flatnonzero(np.diff(np.r_[False, covered, False].astype(np.int8)))
    return ",".join(f"{a}-{b}" for a, b in edge.reshape(-1, 2).tolist())


def _kept_rows(window: int, with_text: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans")
            out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": [], "removed_spans": [], "differing": [], "kept": []}
            for first, end, data, offsets in text_blocks(batch):
                text = Words(data, offsets)
                for i in range(end - first):
                    n = text.count(i)
                    change = np.zeros(n + 1, np.int64)
                    differing = 0
                    for span in spans[first + i].as_py() or ():
                        stop = span["p"] + span["n"] + window - 1
                        if text.digest(i, span["p"], stop) != span["digest"]:
                            differing += 1
                            continue
                        change[span["p"]] += 1
                        change[stop] -= 1
                    covered = np.cumsum(change[:-1]) > 0
                    kept = text.kept(i, covered)
                    if with_text:
                        out["kept"].append(kept)
                    out["n_words"].append(n)
                    out["n_removed"].append(int(covered.sum()))
                    out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                    out["removed_spans"].append(_written(covered))
                    out["differing"].append(differing)
            shown = {"kept_text": pa.array(out["kept"], pa.binary()).cast(pa.string())} if with_text else {}
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()),
                "kept_sha256": pa.array(out["kept_sha256"], pa.string()), "removed_spans": pa.array(out["removed_spans"], pa.string()),
                "differing": pa.array(out["differing"], pa.int32()), "copies": batch.column("copies"), **shown,
            })

    return rows


def _named(docs: DataFrame) -> DataFrame:
    """(doc_id, d, v, text, copies): v is a hash of the text where the id is null or stands in several rows, else 0.

    d and v name a document and order it; rows that repeat one are a single row here, with their number.
    """
    digest = F.xxhash64("text")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    groups = texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), (F.min(digest) != F.max(digest)).alias("several"))
    shared = checkpointed(groups.where("doc_id IS NULL OR rows > 1").select(F.col("doc_id").alias("shared_id"), (F.col("several") | F.col("doc_id").isNull()).alias("several")))
    n = shared.limit(SHARED_IDS + 1).count()
    d = F.coalesce("doc_id", F.lit(NULL_ID)).alias("d")
    if n == 0:
        return texts.select("doc_id", d, F.lit(0).cast("long").alias("v"), "text", F.lit(1).cast("long").alias("copies"))
    joined = texts.join(F.broadcast(shared) if n <= SHARED_IDS else shared, F.col("doc_id").eqNullSafe(F.col("shared_id")), "left")
    named = joined.select("doc_id", d, F.when(F.col("several"), digest).otherwise(F.lit(0)).cast("long").alias("v"), "text")
    grouped = named.groupBy("d", "v", F.col("doc_id").isNull().alias("no_id")).agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    return grouped.select("doc_id", "d", "v", "text", "copies")


def _sourced(rows: DataFrame, deal: Sequence[str]) -> DataFrame:
    """Rows with `first`, the first coordinate of their (k, t), and `nearest`, the one before theirs; dealt by the given
    columns, so they end sorted by content."""
    dealt = rows.repartition(*deal).sortWithinPartitions(*deal, *(c for c in ("k", "t", "d", "v", "p") if c not in deal))
    same = Window.partitionBy(*deal, *(c for c in ("k", "t") if c not in deal)).orderBy("d", "v", "p")
    at = F.struct("d", "v", "p")
    return dealt.withColumns({"first": F.first(at).over(same), "nearest": F.lag(at).over(same)})


def _repeated(rows: DataFrame) -> DataFrame:
    """(d, v, p, n, sd, sv, sp) of the rows that have an earlier copy. Its source is the one found where the row was
    made, or else the nearest in its own document, or else the first."""
    inside = F.col("sd").isNotNull() & F.col("sv").isNotNull() & F.col("sp").isNotNull()
    later = F.struct("d", "v", "p") != F.col("first")
    own = (F.col("nearest.d") == F.col("d")) & (F.col("nearest.v") == F.col("v"))
    source = lambda x: F.when(inside, F.col(f"s{x}")).when(own, F.col(f"nearest.{x}")).otherwise(F.col(f"first.{x}")).alias(f"s{x}")
    return rows.where(inside | later).select("d", "v", "p", "n", *map(source, "dvp"))


def _compacted(pieces: DataFrame) -> DataFrame:
    """Spans (d, v, p, n, sd, sv, sp): runs of repeated pieces that are neighbours in their document and at the source."""
    along = Window.partitionBy("d", "v").orderBy("p")
    goes_on = (
        (F.lag(F.col("p") + F.col("n")).over(along) == F.col("p")) & (F.lag("sd").over(along) == F.col("sd")) & (F.lag("sv").over(along) == F.col("sv"))
        & (F.lag(F.col("sp") - F.col("p")).over(along) == F.col("sp") - F.col("p"))
    )
    marked = pieces.withColumn("starts", F.when(goes_on, 0).otherwise(1)).withColumn("path", F.sum("starts").over(along))
    return marked.groupBy("d", "v", "path").agg(F.min("p").alias("p"), F.sum("n").alias("n"), F.first("sd").alias("sd"), F.first("sv").alias("sv"), F.min("sp").alias("sp")).drop("path")


def _attempt(texts: DataFrame, window: int, gram: int, with_text: bool, seed: int, bits: int) -> DataFrame:
    notable = checkpointed(texts.mapInArrow(_heavy_rows(window, gram, seed, bits), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")))
    every = notable.where("k IS NULL").first()
    least = max(HEAVY_LEAST, (every.n if every else 0) // HEAVY_SHARE)
    chosen = notable.where((F.col("n") >= least) & F.col("k").isNotNull()).select("k", F.lit(True).alias("heavy"))  # at most HEAVY_SHARE
    heavy = np.array([r.k for r in chosen.select("k").collect()], np.int64).view(np.uint64)
    pieces = texts.mapInArrow(_piece_rows(window, gram, seed, bits, heavy), f"k long, t long, d long, v long, p int, {_SOURCE}")
    salted = pieces.join(F.broadcast(chosen), "k", "left").withColumn("salt", F.when(F.col("heavy"), F.pmod(F.col("t"), F.lit(HEAVY_SALTS)).cast("int") + 1).otherwise(0)).drop("heavy")
    group = Window.partitionBy("k", "salt")
    found = _sourced(salted, ["k", "salt"]).withColumn("branch", (F.col("salt") > 0) | (F.min("t").over(group) != F.max("t").over(group)))
    at_first = F.col("sd").isNull() & F.col("sv").isNull() & F.col("sp").isNull() & (F.struct("d", "v", "p") == F.col("first"))
    opened = found.where(at_first & F.col("branch")).groupBy("d", "v").agg(F.collect_list(F.col("p").cast("long") * (1 << _LENGTH_BITS) + F.col("n")).alias("opened"))
    # All three joins take the same columns of the texts, so Spark shuffles them once and reuses the exchange.
    columns = ["doc_id", "d", "v", "text", "copies"]
    edges = texts.join(opened, ["d", "v"]).select(*columns, "opened").mapInArrow(_edge_rows(window, seed, bits), f"k long, t long, d long, v long, p int, {_SOURCE}")
    spans = _compacted(_repeated(found).unionByName(_repeated(_sourced(edges, ["k", "t"]))))
    asked = spans.groupBy(F.col("sd").alias("d"), F.col("sv").alias("v")).agg(F.collect_set(F.col("sp").cast("long") * 2**32 + F.col("n")).alias("asked"))
    digests = texts.join(asked, ["d", "v"]).select(*columns, "asked").mapInArrow(_digest_rows(window), "sd long, sv long, sp int, n long, digest binary")
    listed = spans.join(digests, ["sd", "sv", "sp", "n"]).groupBy("d", "v").agg(F.collect_list(F.struct("p", "n", "digest")).alias("spans"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed_spans string, differing int, copies long"
    whole = texts.join(listed, ["d", "v"], "left").select(*columns, "spans")
    return checkpointed(whole.mapInArrow(_kept_rows(window, with_text), f"{schema}, kept_text string" if with_text else schema))


def remove_repeated(docs: DataFrame, window: int = WINDOW, gram: int = MINIMIZER, with_text: bool = False, attempts: Sequence[int] = ATTEMPTS) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): n_words, n_removed, kept_sha256, removed_spans.

    A word goes if a window of `window` words covers it whose word sequence also starts earlier: in a smaller doc_id,
    or earlier in the same document. removed_spans lists word ranges `start-end` (end exclusive); `with_text` adds
    kept_text, the words that stay, joined by spaces. `attempts` has the bits of the hashes of each attempt.

    A null text has no words; texts shorter than a window lose none; an empty table gives an empty one. Texts of any
    length are hashed in parts. A null doc_id counts as 2**63 - 1. doc_id and text name a document: different texts
    with one id, or with none, are ordered by a hash; equal rows are one document again, none of them earlier than the
    others, and each gets its row. Other columns are ignored, whatever their names.
    """
    texts = _named(docs)
    for seed, bits in enumerate(attempts):
        out = _attempt(texts, window, gram, with_text, seed, bits)
        if out.where("differing > 0").isEmpty():
            repeated = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            return repeated.drop("differing", "copies", "copy")
    raise RuntimeError("repeated spans differ from their sources in every attempt")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """remove_repeated over all of `documents`, windows of 20 words; its edge cases hold."""
    return remove_repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same by single windows, compared as text.
OP1_SQL = """
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^ \\t-\\r]+'), []) AS words FROM documents),
windows AS (
  SELECT doc_id, i AS place, doc_id::HUGEINT * 4294967296 + i AS coordinate, array_to_string(words[i:i + 19], ' ') AS content
  FROM w, unnest(range(1, len(words) - 18)) AS t(i)),
firsts AS (SELECT content, min(coordinate) AS first FROM windows GROUP BY content),
covered AS (
  SELECT DISTINCT doc_id, place + k AS place FROM windows JOIN firsts USING (content), range(0, 20) AS r(k) WHERE coordinate > first),
words AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM w),
kept AS (
  SELECT doc_id, count(*) FILTER (WHERE c.place IS NOT NULL) AS n_removed,
         string_agg(word, ' ' ORDER BY words.place) FILTER (WHERE c.place IS NULL) AS text
  FROM words LEFT JOIN covered c USING (doc_id, place) GROUP BY doc_id),
islands AS (
  SELECT doc_id, min(place) AS a, max(place) AS b
  FROM (SELECT doc_id, place, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS island FROM covered) GROUP BY doc_id, island),
spans AS (SELECT doc_id, string_agg((a - 1) || '-' || b, ',' ORDER BY a) AS removed_spans FROM islands GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256, coalesce(removed_spans, '') AS removed_spans
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id LEFT JOIN spans ON w.doc_id = spans.doc_id
"""
