"""Secret scans with multipart credential linking.

Strong kinds stand alone: assignments of long values to secret names, access identifiers, long hex runs. Weak parts
(an account name, a short password, a pwd, pass or private_key of any length, a bare 40-character key, a service
address) mean little alone. An interval join links them: parts of one document whose starts are SCOPE characters apart
at most, found by an equi-join on the document and on bins of SCOPE characters. A weak secret is reported if an identifier or an endpoint is in its scope, a weak
identifier if a secret is, an endpoint if an identifier and a secret are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed

KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
SCOPE = 240
MASK = "[SECRET]"

_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: Names may carry a prefix that ends in a mark (DB_USER), but not in a letter or digit.
_IDENTIFIER = re.compile(r"""(?ai)(?<![A-Za-z0-9])(?:user(?:_?name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,64}""")
#: Group 1: names that no strong kind covers, so their values may be of any length.
_SHORT = re.compile(r"""(?ai)(?<![A-Za-z0-9])(?:(pwd|pass|private_?key)|password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_BARE = re.compile(r"(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]{0,39}[0-9])(?=[A-Za-z0-9+/]{0,39}[A-Z])(?=[A-Za-z0-9+/]{0,39}[a-z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])")
_ENDPOINT = re.compile(r"""(?ai)(?<![A-Za-z0-9])(?:https?|ftp|ssh|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis)://[^\s"'<>]{3,}|(?<![A-Za-z0-9])(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{3,64}""")
_LEAST_ASSIGN, _LEAST_ACCESS, _LEAST_SHORT = 12, 18, 4

_SECRET_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key", "pwd", "pass", "private")
_OTHER_NAMES = ("user", "login", "account", "client", "access", "host", "endpoint", "server", "://")


def strong_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the strong kinds, sorted; leftmost and non-overlapping within a kind."""
    low = text.lower()
    out = [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _LEAST_ACCESS]
    if any(name in low for name in _SECRET_NAMES[:6]):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= _LEAST_ASSIGN]
    return sorted(out)


def weak_spans(text: str, strong: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of weak parts that overlap no strong span but hex: hex has no part in linking, its name has."""
    low = text.lower()
    out = [(m.start(), 4, m.end()) for m in _BARE.finditer(text)]
    if any(name in low for name in _SECRET_NAMES):
        out += [(m.start(), 4, m.end()) for m in _SHORT.finditer(text) if _LEAST_SHORT <= m.end(2) - m.start(2) and (m[1] or m.end(2) - m.start(2) < _LEAST_ASSIGN)]
    if any(name in low for name in _OTHER_NAMES):
        out += [(m.start(), 3, m.end()) for m in _IDENTIFIER.finditer(text)]
        out += [(m.start(), 5, m.end()) for m in _ENDPOINT.finditer(text)]
    ends = iter([*(s for s in strong if s[1] != 2), (len(text) + 1, 0, len(text) + 1)])
    kept, (start, _, end), reach = [], next(ends), 0
    for part in sorted(set(out)):
        while start <= part[0]:
            reach = max(reach, end)
            start, _, end = next(ends)
        if part[0] >= reach and part[2] <= start:
            kept.append(part)
    return kept


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by MASK."""
    out, at = [], 0
    for a, _, b in sorted(spans):
        if a >= at:
            out += [text[at:a], MASK]
        at = max(at, b)
    return "".join([*out, text[at:]])


_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
_SPANS = "array<struct<start: int, kind: int, end: int>>"


def _as_rows(spans: list[tuple[int, int, int]]) -> list[dict]:
    return [{"start": a, "kind": k, "end": b} for a, k, b in spans]


def _scan_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, digests, strong, weak = ([], [], []), [], [], []
        for value in batch.column("text"):
            text = value.as_py() or ""
            found = strong_spans(text)
            for k in range(3):
                counts[k].append(sum(s[1] == k for s in found))
            digests.append(hashlib.sha256(written(found).encode()).hexdigest())
            strong.append(_as_rows(found))
            weak.append(_as_rows(weak_spans(text, found)))
        yield pa.record_batch({
            "doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"),
            **{f"n_{KINDS[k]}": pa.array(counts[k], pa.int64()) for k in range(3)},
            "base_sha256": pa.array(digests, pa.string()), "strong": pa.array(strong, pa.list_(_SPAN)), "weak": pa.array(weak, pa.list_(_SPAN)),
        })


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of `docs`: counts, base_sha256, strong spans and weak parts; text_hash with doc_id names the text."""
    picked = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash"), F.col("text").cast("string"))
    return picked.mapInArrow(_scan_rows, f"doc_id long, text_hash long, n_assign long, n_access long, n_hex long, base_sha256 string, strong {_SPANS}, weak {_SPANS}")


def linked_parts(scanned: DataFrame) -> DataFrame:
    """(id, text_hash, linked): for each document with any, the weak parts whose complements co-occur in scope."""
    # Equal rows are one document here; copies under other ids keep their own row.
    own = scanned.where(F.size("weak") > 0).select(F.col("doc_id").alias("id"), "text_hash", "strong", "weak").dropDuplicates(["id", "text_hash"])
    parts = own.select("id", "text_hash", F.explode(F.concat("strong", "weak")).alias("part")).where("part.kind <> 2")
    parts = parts.select("id", "text_hash", "part", F.col("part.start").alias("at"), F.floor(F.col("part.start") / SCOPE).alias("bin"))
    left = parts.where("part.kind >= 3").select("id", "text_hash", "part", "at", F.explode(F.array(*(F.col("bin") + i for i in (-1, 0, 1)))).alias("bin"))
    right = parts.select(F.col("id").alias("other_id"), F.col("text_hash").alias("other_hash"), F.col("bin").alias("other_bin"), F.col("part").alias("other"), F.col("at").alias("other_at"))
    near = left.join(right, left["id"].eqNullSafe(right["other_id"]) & (left["text_hash"] == right["other_hash"]) & (left["bin"] == right["other_bin"]) & (F.abs(left["at"] - right["other_at"]) <= SCOPE))
    kind = F.col("other.kind")
    seen = near.groupBy("id", "text_hash", "part").agg(
        F.max(kind.isin(1, 3)).alias("identifier"), F.max(kind.isin(0, 4)).alias("secret"), F.max(kind == 5).alias("endpoint")
    )
    enough = (
        ((F.col("part.kind") == 3) & F.col("secret")) | ((F.col("part.kind") == 4) & (F.col("identifier") | F.col("endpoint")))
        | ((F.col("part.kind") == 5) & F.col("identifier") & F.col("secret"))
    )
    return seen.where(enough).groupBy("id", "text_hash").agg(F.collect_list("part").alias("linked"))


def _names(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for each row of `docs` (doc_id, text).

    A null text counts as empty and has no spans. Offsets are code points, ends exclusive. Texts are scanned whole,
    whatever their length. Repeated rows each get a row; an empty table gives an empty one; other columns are ignored,
    whatever their names. The part lists that are collected belong to one document each.
    """
    scanned = checkpointed(scan(docs))
    linked = linked_parts(scanned)
    joined = scanned.alias("s").join(linked.withColumnRenamed("text_hash", "linked_hash"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("linked_hash")), "left")
    every = F.concat("strong", F.coalesce(F.col("linked"), F.array().cast(_SPANS)))
    return joined.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", _names(every).alias("spans"))


def _mask_rows(weak: bool):
    """Masks the rows that have weak parts, or those that have none: all strong spans, and those of the column links."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, texts = [], []
            linked = batch.column("links")
            for i, value in enumerate(batch.column("text")):
                text = value.as_py()
                spans = strong_spans(text or "")
                if weak != bool(weak_spans(text or "", spans)):
                    continue
                if linked[i].is_valid:
                    spans = spans + [(x["start"], x["kind"], x["end"]) for x in linked[i].as_py()]
                kept.append(i)
                texts.append(masked(text, spans) if spans else text)
            yield pa.record_batch([batch.column("packed").take(pa.array(kept, pa.int64())), pa.array(texts, pa.string())], names=["packed", "text"])

    return rows


def _weak_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [bool(weak_spans(t, strong_spans(t))) for t in (v.as_py() or "" for v in batch.column("text"))]
        yield batch.filter(pa.array(found, pa.bool_()))


def mask_secrets(docs: DataFrame) -> DataFrame:
    """The rows of `docs` (doc_id, text and any others) with every found span of the text replaced by MASK, and n_chars
    (if there) counted anew.

    Only documents with weak parts shuffle their text, to meet their links; all others are masked where they are read.
    Null texts stay null and empty ones empty; texts are scanned whole; repeated rows each keep theirs; an empty table
    gives an empty one; all other columns keep their names and values, whatever they are.
    """
    found = linked_parts(scan(docs).where(F.size("weak") > 0))
    linked = checkpointed(found.select(F.col("id").alias("secret_id"), F.col("text_hash").alias("secret_hash"), F.col("linked").alias("links")))
    others = [c for c in docs.columns if c.lower() != "text"]
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("packed"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([packed.schema["packed"], T.StructField("text", T.StringType())])
    plain = packed.withColumn("links", F.lit(None).cast(_SPANS)).mapInArrow(_mask_rows(weak=False), schema)
    doubtful = packed.mapInArrow(_weak_rows, schema)
    known = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    met = doubtful.join(linked, F.col("packed.doc_id").cast("long").eqNullSafe(F.col("secret_id")) & (known == F.col("secret_hash")), "left").select("packed", "text", "links")
    out = plain.unionByName(met.mapInArrow(_mask_rows(weak=True), schema))
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*((own[c.lower()] if c.lower() in own else F.col(f"packed.`{c}`")).alias(c) for c in docs.columns))


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    """find_secrets in all of `documents`; its edge cases hold."""
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
