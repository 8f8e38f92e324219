"""Spelling variant grouping by a symmetric-delete join.

Every word emits a key for itself and one for each of its distinct single deletions. Two words one edit apart share a
key: the shorter word itself, or what is left of both without the replaced letter. Spark joins the keys, and a condition
of the join keeps the pairs whose distance is exactly one; transposed letters and colliding hashes fail it. A key of L
letters is shared by at most one word for each place and letter, so its group is bounded by the alphabet and not by the
corpus, and the join emits no pair but the near ones.

Pairs are aggregated to a count and a best neighbour for each word. Roots come from pointer jumping over forms, which
only lead to words at least `ratio` times as frequent, so a chain is never longer than the logarithm of the counts.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, mix64, table

LEAST_LETTERS = 7
LEAST_COUNT = 2
RATIO = 10
#: One in so many runs of a document loses a letter before it is counted.
DAMAGE = 31
#: Longer words travel as digests and are looked up again for the exact check.
LONG_WORD = 64
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_PORTION = 1 << 20
_WORDS_HELD = 200_000
_LETTERS_AT_A_TIME = 1 << 17

_LETTER = np.zeros(256, bool)
_LETTER[128:] = True
_LETTER[ord("A") : ord("Z") + 1] = True
_LETTER[ord("a") : ord("z") + 1] = True


def _portions(data: memoryview) -> Iterator[str]:
    """The text with A-Z lower-cased, in portions that end where no run goes on."""
    at, n = 0, len(data)
    while at < n:
        stop = min(n, at + _PORTION)
        while stop < n and _LETTER[data[stop]]:
            ahead = np.flatnonzero(~_LETTER[np.frombuffer(data[stop : stop + 65536], np.uint8)])
            stop = stop + int(ahead[0]) if ahead.size else min(n, stop + 65536)
        yield bytes(data[at:stop]).lower().decode()
        at = stop


def _counted(least_letters: int, damage: int):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}

        def flush() -> pa.RecordBatch:
            rows = pa.record_batch({"word": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})
            counts.clear()
            return rows

        for batch in batches:
            for doc, text in zip(batch.column("doc"), batch.column("text"), strict=True):
                if not text.is_valid:
                    continue
                prefix = zlib.crc32(f"{doc.as_py() or ''}:".encode())
                for portion in _portions(memoryview(text.as_buffer())):
                    for word, k in Counter(_RUN.findall(portion)).items():
                        size = len(word)
                        if size < least_letters:
                            continue
                        if damage:
                            h = zlib.crc32(word.encode(), prefix)
                            if h % damage == 0:
                                if size == least_letters:
                                    continue
                                word = word[: h % size] + word[h % size + 1 :]
                        counts[word] = counts.get(word, 0) + k
                    if len(counts) >= _WORDS_HELD:
                        yield flush()
        yield flush()

    return counted


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, damage: int = 0) -> DataFrame:
    """(word, n): how often each run of letters of at least so many code points occurs in all texts, A-Z lower-cased.

    With `damage`, a run whose crc32 of `doc_id:run` it divides loses one code point first. Tasks count before they
    shuffle, so a very frequent word is a row for each task.
    """
    picked = docs.select(F.col("doc_id").cast("string").alias("doc"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(_counted(least_letters, damage), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _tag(word: str) -> str:
    return word if len(word) <= LONG_WORD else "#" + hashlib.sha256(word.encode()).hexdigest()


def _deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row of words, key) of every word and of its distinct single deletions. A key is a 64-bit hash of the letters."""
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    sizes = np.array([len(w) for w in words], np.int64)
    first = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(sizes.size), sizes)
    place = np.arange(letters.size) - first[row]
    powers = np.cumprod(np.full(int(sizes.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
    value = mix64(letters.astype(np.uint64) + np.uint64(1))
    # Sums up to a letter as it stands, and of the letters behind it moved one place to the left.
    here = np.r_[np.uint64(0), np.cumsum(value * powers[place])]
    left = np.r_[np.uint64(0), np.cumsum(value * np.where(place > 0, powers[place - 1], np.uint64(0)))]
    starts, ends = first, first + sizes
    whole = here[ends] - here[starts]
    # Letters of one run leave the same word behind, so only the first of a run is deleted.
    at = np.flatnonzero((place == 0) | np.r_[True, letters[1:] != letters[:-1]])
    owner = row[at]
    without = here[at] - here[starts[owner]] + left[ends[owner]] - left[at + 1]
    lengths = np.r_[sizes, sizes[owner] - 1].astype(np.uint64)
    return np.r_[np.arange(sizes.size), owner], mix64(np.r_[whole, without] ^ mix64(lengths))


def _emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def emit(words: list[str], counts: list[int]) -> pa.RecordBatch:
        row, key = _deletion_keys(words)
        tags = pa.array([_tag(w) for w in words], pa.string())
        return pa.record_batch({"key": pa.array(key.view(np.int64)), "tag": tags.take(pa.array(row)), "n": pa.array(counts, pa.int64()).take(pa.array(row))})

    for batch in batches:
        words, counts, letters = [], [], 0
        for word, n in zip(batch.column("word"), batch.column("n"), strict=True):
            words.append(word.as_py())
            counts.append(n.as_py())
            letters += len(words[-1])
            if letters >= _LETTERS_AT_A_TIME:
                yield emit(words, counts)
                words, counts, letters = [], [], 0
        if words:
            yield emit(words, counts)


def near_words(words: DataFrame) -> DataFrame:
    """(a, b, b_n): every ordered pair of different words of `words` (word, n; distinct, not empty) at distance one."""
    keys = words.mapInArrow(_emitted, "key long, tag string, n long")
    a, b = keys.select("key", F.col("tag").alias("a")), keys.select("key", F.col("tag").alias("b"), F.col("n").alias("b_n"))
    long_ = F.col("a").startswith("#") | F.col("b").startswith("#")
    found = checkpointed(a.join(b, "key").where((F.col("a") != F.col("b")) & (long_ | (F.levenshtein("a", "b", 1) == 1))).select("a", "b", "b_n"))
    short = found.where(~long_)
    if found.where(long_).isEmpty():
        return short
    texts = words.where(F.char_length("word") > LONG_WORD).select(F.concat(F.lit("#"), F.sha2("word", 256)).alias("digest"), F.col("word").alias("text"))
    of = lambda side: texts.select(F.col("digest").alias(side), F.col("text").alias(f"{side}_text"))
    looked = found.where(long_).join(of("a"), "a", "left").join(of("b"), "b", "left")
    looked = looked.select(F.coalesce("a_text", "a").alias("a"), F.coalesce("b_text", "b").alias("b"), "b_n")
    return short.unionByName(looked.where(F.levenshtein("a", "b", 1) == 1))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word that each word of `forms` (word, form) leads to."""
    roots = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("top"))
        jumped = checkpointed(roots.join(up, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")))
        roots = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            return roots


def grouped_variants(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: int = RATIO, damage: int = 0) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of `docs` (doc_id, text; other columns are ignored) with at
    least so many letters and occurrences.

    A word's form is its near word of largest n (ties: the smallest in code-point order) if that is at least `ratio`
    times its own, else null; root is where the forms end, the word itself without one. Null and empty texts have no
    words; a null doc_id counts as an empty one in the damage; texts of any length are read in portions, and a word of
    any length is a word; repeated rows count again; an empty table gives an empty one.
    """
    words = checkpointed(word_counts(docs, least_letters, damage).where(F.col("n") >= least_count))
    best = F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form")))
    near = near_words(words).groupBy(F.col("a").alias("word")).agg(F.count_distinct("b").alias("n_near"), best.alias("best"))
    counted = words.join(near, "word", "left").withColumn("form_n", -F.col("best.less"))
    formed = F.col("form_n") >= F.col("n") * ratio
    counted = checkpointed(counted.select(
        "word", F.when(formed, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("form_n")).alias("form_n")
    ))
    roots = _roots(counted.where("form IS NOT NULL"))
    return counted.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """grouped_variants over all of `documents`, with the dealt damage; its edge cases hold."""
    return grouped_variants(table(spark, sf_dir, "documents"), damage=DAMAGE)


OP12_SQL = """
WITH crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, b) ORDER BY b) AS t FROM range(256) r(b)),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
pairs AS (SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (
  SELECT run, k,
         xor(list_reduce(list_transform(range((length(h) / 2)::BIGINT), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
                         lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8), 4294967295), 4294967295) AS crc
  FROM (SELECT run, k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM pairs), crc_table),
counted AS (
  SELECT CASE WHEN crc % 31 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, k FROM hashed),
words AS (SELECT word, sum(k)::BIGINT AS n FROM counted WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
places AS (SELECT word, n, unnest(range(length(word))) AS p FROM words),
cut AS (SELECT DISTINCT word, n, substr(word, 1, p) || substr(word, p + 2) AS rest FROM places),
masked AS (SELECT word, n, substr(word, 1, p) || '*' || substr(word, p + 2) AS rest FROM places),
near AS (
  SELECT a.word AS a, b.word AS b, b.n AS b_n FROM masked a JOIN masked b ON a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word),
best AS (SELECT a AS word, count(*) AS n_near, first(b ORDER BY b_n DESC, encode(b)) AS b, max(b_n) AS b_n FROM near GROUP BY a),
formed AS (
  SELECT w.word, CASE WHEN b.b_n >= 10 * w.n THEN b.b END AS form, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.b_n >= 10 * w.n THEN b.b_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
chain AS (
  WITH RECURSIVE up(word, root) AS (
    SELECT word, form FROM formed WHERE form IS NOT NULL
    UNION ALL SELECT up.word, f.form FROM up JOIN formed f ON f.word = up.root WHERE f.form IS NOT NULL)
  SELECT up.word, up.root FROM up JOIN formed f ON f.word = up.root WHERE f.form IS NULL)
SELECT f.word, f.form, coalesce(c.root, f.word) AS root, f.n, f.n_near, f.form_n FROM formed f LEFT JOIN chain c USING (word)
"""
