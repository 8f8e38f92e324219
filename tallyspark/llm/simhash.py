"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint is a 64-bit SimHash over word shingles. Two fingerprints link at three or fewer differing bits.
Each distinct fingerprint has the variants around it that two linked fingerprints are sure to share:

* itself and all 64 variants with one bit flipped, and
* all variants with two of its set bits cleared.

Why that finds every link: let a and b differ in d <= 3 bits. d <= 1: one is a variant of the other. d = 2: both
reach either common neighbour by one flip. d = 3: one of the two, say a, has at least two of the three bits set;
clearing two of them leaves one difference, which is one flip of b. That is about 560 variants instead of the 2081
of the whole ball of radius two.

Variants shuffle by their highest KEY_BITS bits (more for very many fingerprints). One row (key, fingerprint) stands
for all variants of the fingerprint with that key, which the receiver writes out again: about 45 rows of two numbers
each for 560 variants. The bits of a key follow the number of fingerprints slowly, and so do the rows: 113 of them for
5 * 10**10 fingerprints. Clusters of fingerprints that agree in their highest bits share keys; a key with more than
KEY_VARIANTS variants is not worked on where it lands but dealt again, each of its variants on its own. A single variant
has 2081 members at most, so that splits any cluster.

At a variant, members one flip away or less (the core) lie within two bits of each other, and within three of
those two flips away. Linking every member to the smallest core member therefore keeps all reachability without
listing all pairs; each emitted pair is deduplicated and verified by its differing bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, single_spaced, text_parts, words_of
from .components import connected_components

SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
#: Bits of a key at least, and rows of a key on average, at most, before it gets more.
KEY_BITS = 16
ROWS_PER_KEY = 32_768
#: Variants that a task holds at a time; a key with more is dealt again by variant.
KEY_VARIANTS = 1 << 21
FINGERPRINTS_PER_TASK = 16_384
LEAST_TASKS = 8
_ROWS_PER_FINGERPRINT = 64
_FINGERPRINTS_AT_A_TIME = 4096
_SHINGLES_AT_A_TIME = 1 << 17

_ONE = np.uint64(1) << np.arange(64, dtype=np.uint64)


def _lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return np.where((data >= 65) & (data <= 90), data | 32, data)


def _shingles(rows: np.ndarray, data: np.ndarray, offsets: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, unsigned XXH64) of every shingle of the texts between the offsets, repeats included. A text of fewer words is
    one shingle where `fresh`, as nothing of it came before."""
    start, end, first = words_of(data, offsets)
    spaced, at = single_spaced(_lowered(data), start)
    sizes = np.diff(first)
    # A shingle at each word that has enough of its text behind it, and at the first of a short text.
    reach = np.minimum(np.repeat(first[1:], sizes), np.arange(start.size) + SHINGLE_WORDS)
    whole = reach - np.arange(start.size) == SHINGLE_WORDS
    short = fresh & (sizes > 0) & (sizes < SHINGLE_WORDS)
    whole[first[:-1][short]] = True
    begins = np.flatnonzero(whole)
    last = reach[begins] - 1
    text, digest = spaced.tobytes(), xxhash.xxh64_intdigest
    ends = at[last] + end[last] - start[last]
    hashes = np.fromiter((digest(text[a:b], SEED) for a, b in zip(at[begins].tolist(), ends.tolist(), strict=True)), np.uint64, begins.size)
    return np.repeat(rows, sizes)[begins], hashes


def _bits(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Fingerprints from how often each bit was set (most significant bit first)."""
    return np.packbits(counts * 2 > totals[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Long texts come in parts, of which each adds to its text's 64 counts."""
    for batch in batches:
        n = batch.num_rows
        counts, totals = np.zeros((n, 64), np.int64), np.zeros(n, np.int64)
        for rows, before, data, offsets in text_parts(batch, SHINGLE_WORDS - 1):
            row, hashes = _shingles(rows, data, offsets, (before == 0) & (totals[rows] == 0))
            for k in range(0, row.size, _SHINGLES_AT_A_TIME):
                own = row[k : k + _SHINGLES_AT_A_TIME]
                bits = np.unpackbits(hashes[k : k + _SHINGLES_AT_A_TIME].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
                firsts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                counts[own[firsts]] += np.add.reduceat(bits, firsts, axis=0, dtype=np.int64)
            totals += np.bincount(row, minlength=n)
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "fp": pa.array(_bits(counts, totals).view(np.int64))})


def _text_hash():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp): the fingerprint as a signed long. Null and empty texts have fingerprint zero."""
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("text_hash"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(_fingerprints, "doc_id long, text_hash long, fp long")


def _set_pairs(fps: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of fps, mask of two bits) of every pair of set bits among the bits low..high-1."""
    set_bits = (fps[:, None] & _ONE[low:high]) != 0
    weight = set_bits.sum(axis=1)
    rows, masks = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for w in np.unique(weight[weight >= 2]):
        own = np.flatnonzero(weight == w)
        places = np.nonzero(set_bits[own])[1].reshape(own.size, w) + low
        i, j = np.triu_indices(w, 1)
        rows.append(np.repeat(own, i.size))
        masks.append((_ONE[places[:, i]] | _ONE[places[:, j]]).ravel())
    return np.concatenate(rows), np.concatenate(masks)


def _keys(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of fps, key) for all different highest `bits` bits among the variants of each fingerprint."""
    n, low = fps.size, 64 - bits
    pairs, masks = _set_pairs(fps, low, 64)
    rows = np.concatenate([np.arange(n), np.repeat(np.arange(n), bits), pairs])
    return rows, (fps[rows] ^ np.concatenate([np.zeros(n, np.uint64), np.tile(_ONE[low:], n), masks])) >> np.uint64(low)


def _variants(fps: np.ndarray, keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, variant, rim) of the variants of each fingerprint with the given key; rim ones are two flips away."""
    low = 64 - bits
    flips = ((fps >> np.uint64(low)) ^ keys) << np.uint64(low)
    far = np.bitwise_count(flips)
    every = np.arange(fps.size)
    out = [(every, fps ^ flips, far == 2)]
    near = np.flatnonzero(far == 0)
    rows = np.repeat(near, low)
    out.append((rows, fps[rows] ^ np.tile(_ONE[:low], near.size), np.zeros(rows.size, bool)))
    rows, masks = _set_pairs(fps[near], 0, low)
    out.append((near[rows], fps[near[rows]] ^ masks, np.ones(rows.size, bool)))
    cleared = np.flatnonzero((far == 1) & ((fps & flips) != 0))
    row, bit = np.nonzero((fps[cleared][:, None] & _ONE[:low]) != 0)
    rows = cleared[row]
    out.append((rows, fps[rows] ^ flips[rows] ^ _ONE[bit], np.ones(rows.size, bool)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _number_of_variants(fps: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    low = np.uint64(64 - bits)
    flips = ((fps >> low) ^ keys) << low
    far, weight = np.bitwise_count(flips).astype(np.int64), np.bitwise_count(fps & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    return np.where(far == 0, 1 + int(low) + weight * (weight - 1) // 2, np.where((far == 1) & ((fps & flips) != 0), 1 + weight, 1))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _emit(bits: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("fp").to_numpy().view(np.uint64)
            for k in range(0, every.size, _FINGERPRINTS_AT_A_TIME):
                fps = every[k : k + _FINGERPRINTS_AT_A_TIME]
                row, key = _keys(fps, bits)
                yield pa.record_batch({"key": _signed(key), "fp": _signed(fps[row])})

    return emit


def _pairs(member: np.ndarray, variant: np.ndarray, rim: np.ndarray) -> np.ndarray:
    """Verified pairs [pairs, 2] among the members that share a variant; rim members are two flips away from it."""
    order = np.argsort(variant)
    same = variant[order]
    together = same[1:] == same[:-1]
    keep = order[np.r_[False, together] | np.r_[together, False]] if same.size else order
    variant, member, rim = variant[keep], member[keep], rim[keep]
    if variant.size == 0:
        return np.zeros((0, 2), np.uint64)
    order = np.lexsort((member, rim, variant))
    variant, member, rim = variant[order], member[order], rim[order]
    first = np.flatnonzero(np.r_[True, variant[1:] != variant[:-1]])
    head = np.repeat(first, np.diff(np.r_[first, variant.size]))
    ok = ~rim[head] & (member != member[head]) & (np.bitwise_count(member ^ member[head]) <= RADIUS)
    return np.unique(np.stack([member[head][ok], member[ok]], axis=1), axis=0)


def _link(bits: int, most: int):
    """(key, a, b) from rows (key, fp) sorted by key: verified links of every member of a variant to its smallest member
    within one flip; b is null for the members of a key with more than `most` variants."""

    def pairs(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        row, variant, rim = _variants(fps, keys, bits)
        found = _pairs(fps[row], variant, rim)
        return _links(np.zeros(found.shape[0], np.uint64), found[:, 0], found[:, 1], False)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, crowded = np.zeros(0, np.uint64), np.zeros(0, np.uint64), None
        for batch in batches:
            keys = np.r_[keys, batch.column("key").to_numpy().view(np.uint64)]
            fps = np.r_[fps, batch.column("fp").to_numpy().view(np.uint64)]
            sizes = np.cumsum(_number_of_variants(fps, keys, bits))
            at, before = 0, 0
            while sizes.size and sizes[-1] - before > most:
                if crowded is not None and keys[at] == crowded:
                    end = int(np.searchsorted(keys, crowded, side="right"))
                    yield _links(keys[at:end], fps[at:end], fps[at:end], True)
                else:
                    end = int(np.searchsorted(sizes, before + most, side="right"))
                    end = int(np.searchsorted(keys, keys[end], side="left"))  # whole keys only
                    if end <= at:
                        crowded = keys[at]
                        continue
                    yield pairs(keys[at:end], fps[at:end])
                at, before = end, int(sizes[end - 1])
            keys, fps = keys[at:], fps[at:]
            if crowded is not None and keys.size and keys[0] == crowded:
                end = int(np.searchsorted(keys, crowded, side="right"))
                yield _links(keys[:end], fps[:end], fps[:end], True)
                keys, fps = keys[end:], fps[end:]
        if keys.size:
            yield pairs(keys, fps)

    return link


def _links(key: np.ndarray, a: np.ndarray, b: np.ndarray, open_: bool) -> pa.RecordBatch:
    return pa.record_batch({"key": _signed(key), "a": _signed(a), "b": pa.nulls(b.size, pa.int64()) if open_ else _signed(b)})


def _emit_apart(bits: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, keys = batch.column("fp").to_numpy().view(np.uint64), batch.column("key").to_numpy().view(np.uint64)
            for k in range(0, fps.size, _FINGERPRINTS_AT_A_TIME):
                own = fps[k : k + _FINGERPRINTS_AT_A_TIME]
                row, variant, rim = _variants(own, keys[k : k + _FINGERPRINTS_AT_A_TIME], bits)
                yield pa.record_batch({"variant": _signed(variant), "fp": _signed(own[row]), "rim": pa.array(rim)})

    return emit


def _link_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) from rows (variant, fp, rim) sorted by variant."""
    held: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
    for batch in batches:
        held = [np.r_[x, batch.column(n).to_numpy(zero_copy_only=False)] for x, n in zip(held, ("variant", "fp", "rim"), strict=True)]
        end = int(np.searchsorted(held[0], held[0][-1], side="left")) if held[0].size else 0  # the last variant may go on
        if end:
            found = _pairs(held[1][:end].view(np.uint64), held[0][:end], held[2][:end])
            yield pa.record_batch({"a": _signed(found[:, 0]), "b": _signed(found[:, 1])})
            held = [x[end:] for x in held]
    found = _pairs(held[1].view(np.uint64), held[0], held[2])
    yield pa.record_batch({"a": _signed(found[:, 0]), "b": _signed(found[:, 1])})


def key_bits(n: int) -> int:
    """Bits of a key for so many fingerprints."""
    return min(48, max(KEY_BITS, (n * _ROWS_PER_FINGERPRINT // ROWS_PER_KEY).bit_length()))


def links(distinct: DataFrame, most: int = KEY_VARIANTS) -> DataFrame:
    """(a, b): linked pairs of the distinct fingerprints (fp) that join all that are within reach."""
    n = distinct.count()
    bits = key_bits(n)
    # Few bytes become many: spread the fingerprints before they do.
    spread = distinct.repartition(max(LEAST_TASKS, n // FINGERPRINTS_PER_TASK))
    dealt = spread.mapInArrow(_emit(bits), "key long, fp long").repartition("key").sortWithinPartitions("key")
    found = checkpointed(dealt.mapInArrow(_link(bits, most), "key long, a long, b long"))
    crowded = found.where("b IS NULL").select("key", F.col("a").alias("fp"))
    if crowded.isEmpty():
        return found.select("a", "b")
    apart = crowded.repartition(max(LEAST_TASKS, crowded.count() // _FINGERPRINTS_AT_A_TIME)).mapInArrow(_emit_apart(bits), "variant long, fp long, rim boolean")
    more = apart.repartition("variant").sortWithinPartitions("variant").mapInArrow(_link_apart, "a long, b long")
    return found.where("b IS NOT NULL").select("a", "b").unionByName(more)


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Checkpointed (doc_id, text_hash, fp) of all rows, and (fp, root, least) of the distinct fingerprints; least is the
    smallest doc_id with the fingerprint, root the smallest fingerprint that it reaches."""
    prints = checkpointed(fingerprints(docs))
    distinct = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = connected_components(links(distinct.select("fp")))
    rooted = distinct.join(labels.select(F.col("node").alias("fp"), "root"), "fp", "left")
    return prints, checkpointed(rooted.select("fp", "least", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of `docs` (doc_id, text; other columns are ignored).

    component_id is the smallest doc_id reachable over links, the row's own included. Null and empty texts have
    fingerprint zero and link like any other; a null doc_id keeps its row and never names a component unless all
    of its component's ids are null; repeated rows stay; an empty table gives an empty one. Texts of any length are
    hashed whole, in parts that share two words.
    """
    prints, rooted = _classes(docs)
    named = checkpointed(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    by_print = checkpointed(rooted.join(named, "root").select("fp", "component_id"))
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` (doc_id, text and any others) with one document of each component: that with the smallest
    doc_id (null last), then the smallest hash of its text. Rows that repeat it exactly go too.

    Null and empty texts are one component, so one of them stays. Texts of any length are hashed whole, in parts; an empty
    table gives an empty one; other columns keep their names and values, whatever they are.
    """
    prints, rooted = _classes(docs)
    classed = prints.join(rooted.select("fp", "root"), "fp")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    kept = classed.groupBy("root").agg(F.min(first).alias("kept")).select("kept.*")
    key = lambda id_, hash_: [F.coalesce(F.col(id_), F.lit(0).cast("long")).alias("k_id"), F.col(id_).isNull().alias("k_no_id"), F.col(hash_).alias("k_hash")]
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("own_id"), _text_hash().alias("own_hash"))
    # The rows shuffle once: the semi-join finds them dealt by its keys.
    single = packed.select("row", *key("own_id", "own_hash")).groupBy("k_id", "k_no_id", "k_hash").agg(F.first("row").alias("row"))
    return single.join(checkpointed(kept.select(*key("id", "hash"))), ["k_id", "k_no_id", "k_hash"], "left_semi").select("row.*")


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """near_duplicates over all of `documents`, fingerprints as 16 hexadecimal digits; its edge cases hold."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
