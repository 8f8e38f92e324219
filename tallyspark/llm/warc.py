"""WARC archives: a writer of gzip members with revisit records, and a splittable reader.

Reading: a table of byte ranges is dealt out, and every task scans its ranges for the gzip magic. A candidate counts if
what it inflates to begins with a WARC header that parses; the task owns the records that start inside its range, reads
each to its end, beyond the range if need be, and goes on behind it. Where a member is damaged it scans on.

A record may hold another archive that deflate stores as it is, so a range that begins inside such a record finds the
inner members, which look like records in every way. `settled` takes them out: each range tells where its last record
ends, and what starts before the furthest end of the ranges before it lies inside a record and is none itself.

Writing: tasks write files under names of their own and return them, so that only files of attempts that succeeded are
ever listed. Files are reached through pyarrow's file systems (local or shared folders, hdfs, object stores).
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, shared_folder, table

#: Bytes of a range of one file, and of a file before the task begins another.
SPLIT_BYTES = 32 << 20
FILE_BYTES = 1 << 30
#: The pages carry no time of their own.
DATE = "1970-01-01T00:00:00Z"
_MAGIC = b"\x1f\x8b\x08"
_CHUNK = 1 << 18
_LONGEST_HEADER = 1 << 20
_HEADER_STEP, _HEADER_STEPS = 128, 1024
#: Tasks of a read at most; beyond it a task has several ranges.
MOST_TASKS = 100_000
_BATCH_BYTES = 4 << 20
_BATCH_ROWS = 2000
_HEADER_END = b"\r\n\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_CONTROL = re.compile(r"[\x00-\x20\x7f-\x9f  ]")

FILES = "file string, n_bytes long, n_records long"
RECORDS = (
    "file string, split long, start long, end long, record_id string, record_type string, target_uri string, page_id long, "
    "refers_to_id string, payload_bytes long, payload_digest string, stated_digest string, error string, payload binary"
)
_RECORD_TYPES = pa.schema([(c.split()[0], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]]) for c in RECORDS.split(", ")])


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _header(fields: list[tuple[str, str | None]]) -> bytes:
    return "".join(["WARC/1.1\r\n", *(f"{name}: {value}\r\n" for name, value in fields if value is not None), "\r\n"]).encode()


def _uri(url: str | None) -> str | None:
    """A url on one line: blanks and control characters become %XX."""
    return None if url is None else _CONTROL.sub(lambda m: "".join(f"%{b:02X}" for b in m.group().encode()), url)


class _Out:
    """One archive file of a task."""

    def __init__(self, folder: str) -> None:
        system, path = fs.FileSystem.from_uri(folder)
        name = f"part-{uuid.uuid4()}.warc.gz"
        self.file, self.n_bytes, self.n_records = f"{folder}/{name}", 0, 0
        self.stream = system.open_output_stream(f"{path}/{name}", compression=None)

    def member(self, *parts: bytes | memoryview) -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        for part in parts:
            view = memoryview(part)
            for k in range(0, len(view), _CHUNK):
                self._put(packer.compress(view[k : k + _CHUNK]))
        self._put(packer.flush())
        self.n_records += 1

    def _put(self, data: bytes) -> None:
        if data:
            self.stream.write(data)
            self.n_bytes += len(data)

    def close(self) -> pa.RecordBatch:
        self.stream.close()
        return pa.RecordBatch.from_pylist([{"file": self.file, "n_bytes": self.n_bytes, "n_records": self.n_records}])


def _writer(folder: str, date: str, most: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            columns = [batch.column(c) for c in ("record_id", "record_type", "page_id", "url", "refers_to_id", "sha1", "payload")]
            for record_id, kind, page_id, url, refers, sha1, payload in zip(*columns, strict=True):
                if out is not None and out.n_bytes >= most:
                    yield out.close()
                    out = None
                if out is None:
                    out = _Out(folder)
                body = memoryview(payload.as_buffer()) if payload.is_valid else memoryview(b"")
                response = kind.as_py() == "response"
                http = _HTTP % len(body) if response else b""
                out.member(
                    _header([
                        ("WARC-Type", kind.as_py()), ("WARC-Record-ID", f"<urn:uuid:{record_id.as_py()}>"), ("WARC-Date", date), ("WARC-Target-URI", _uri(url.as_py())),
                        ("WARC-Payload-Digest", f"sha1:{_base32(bytes.fromhex(sha1.as_py()))}"), ("X-Page-ID", None if page_id.as_py() is None else str(page_id.as_py())),
                        ("WARC-Profile", None if response else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                        ("WARC-Refers-To", None if refers.as_py() is None else f"<urn:uuid:{refers.as_py()}>"),
                        ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(http) + (len(body) if response else 0))),
                    ]), http, body if response else b"", _HEADER_END,
                )
        if out is not None:
            yield out.close()

    return write


def _uuid(hexadecimal: Column) -> Column:
    return F.regexp_replace(F.substring(hexadecimal, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def warc_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(record_id, record_type, page_id, url, refers_to_id, sha1, payload): a record for every row of `pages` (page_id,
    url, html; other columns are ignored).

    Of equal payloads of at least so many bytes, that of the largest page_id (null last; then of the largest url) is the
    response and the others revisit it, without a payload; of rows that repeat it in all three, one is the response.
    Smaller payloads are all responses. Null html is an empty payload.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.select("*", F.sha2("html", 256).alias("sha"), F.sha1("html").alias("sha1"), (F.octet_length("html") >= least_bytes).alias("shared"))
    copies = rows.where("shared").groupBy("sha", "page_id", "url").count()
    groups = copies.groupBy("sha").agg(F.max(F.struct("page_id", "url", "count")).alias("best"), F.sum("count").alias("rows")).where("rows > 1")
    groups = checkpointed(groups.select("sha", F.col("best.page_id").alias("best_id"), F.col("best.url").alias("best_url"), F.col("best.count").alias("copies")))
    joined = rows.join(groups, "sha", "left").withColumn("grouped", F.col("shared") & F.col("copies").isNotNull())
    is_best = F.col("grouped") & F.col("page_id").eqNullSafe(F.col("best_id")) & F.col("url").eqNullSafe(F.col("best_url"))

    def records(rows: DataFrame, copy: Column, revisit: Column) -> DataFrame:
        own = F.sha2(F.concat_ws("|", "sha", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.coalesce("url", F.lit("null")), copy.cast("string")), 256)
        return rows.select(
            _uuid(F.when(F.col("grouped") & ~revisit, F.col("sha")).otherwise(own)).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"),
            "page_id", "url", F.when(revisit, _uuid(F.col("sha"))).alias("refers_to_id"), "sha1", F.when(~revisit, F.col("html").cast("binary")).alias("payload"),
        )

    if groups.where("copies > 1").isEmpty():
        return records(joined.withColumn("best", is_best), F.lit(0), F.col("grouped") & ~F.col("best"))
    repeated = F.coalesce(is_best & (F.col("copies") > 1), F.lit(False))
    apart = records(joined.where(~repeated).withColumn("best", is_best), F.lit(0), F.col("grouped") & ~F.col("best"))
    once = joined.where(repeated).groupBy("sha", "page_id", "url", "sha1", "copies", "grouped").agg(F.first("html").alias("html"))
    again = once.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    return apart.unionByName(records(again, F.col("copy"), F.col("copy") > 0))


def write_warc(records: DataFrame, folder: str, date: str = DATE, file_bytes: int = FILE_BYTES) -> DataFrame:
    """(file, n_bytes, n_records) of the archives that the rows of warc_records were written to in `folder`; without
    rows, none. The returned table is checkpointed: it lists the files of the tasks' successful attempts only."""
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    return checkpointed(records.mapInArrow(_writer(folder, date, file_bytes), FILES))


def _parsed(data: bytes) -> dict[str, str] | None:
    """Fields of a WARC header by lower-case name, or None."""
    lines = data.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        return None
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    return fields if fields.get("content-length", "").isdigit() and "warc-type" in fields else None


class _Range:
    """Records that start in [start, end) of one file."""

    def __init__(self, file: str, start: int, end: int, keep_payload: bool) -> None:
        system, path = fs.FileSystem.from_uri(file)
        self.name, self.start, self.end, self.keep = file, start, end, keep_payload
        self.source = system.open_input_file(path)
        self.size = self.source.size()

    def _chunks(self, at: int) -> Iterator[bytes]:
        while at < self.size:
            data = self.source.read_at(min(_CHUNK, self.size - at), at)
            yield data
            at += len(data)

    def _candidate(self, at: int) -> int:
        """Where the next gzip magic begins, or the range's end."""
        while at < self.end:
            data = self.source.read_at(min(_CHUNK, self.size - at), at)
            found = data.find(_MAGIC)
            if found >= 0:
                return min(self.end, at + found)
            if at + len(data) >= self.size:
                break
            at += len(data) - len(_MAGIC) + 1
        return self.end

    def _inflated(self, at: int) -> Iterator[tuple[bytes, int | None]]:
        """(bytes, None) of the member at this offset, then (b"", its end); zlib.error if it is none or is cut off."""
        unpacker, read, made = zlib.decompressobj(31), at, 0
        for data in self._chunks(at):
            read += len(data)
            while data:
                # In small steps at first, so that a header is seen before the checksum of a short member fails.
                out = unpacker.decompress(data, _HEADER_STEP if made < _HEADER_STEPS else _CHUNK)
                made += len(out)
                if out:
                    yield out, None
                if unpacker.eof:
                    yield b"", read - len(unpacker.unused_data)
                    return
                data = unpacker.unconsumed_tail
        raise zlib.error("the member is cut off")

    def _record(self, at: int) -> dict | None:
        """The record at this offset; None if no WARC header begins there."""
        head, fields, kept = b"", None, []
        http, length, total, digest, end = None, 0, 0, hashlib.sha1(), at
        row = {"file": self.name, "split": self.start, "start": at}
        try:
            for data, stop in self._inflated(at):
                if stop is not None:
                    end = stop
                    break
                if fields is None:
                    head += data
                    cut = head.find(_HEADER_END)
                    if cut < 0:
                        if len(head) > _LONGEST_HEADER or not head.startswith(b"WARC/"[: len(head)]):
                            return None
                        continue
                    if (fields := _parsed(head[:cut])) is None:
                        return None
                    data, http = head[cut + 4 :], b"" if fields.get("content-type", "").startswith("application/http") else None
                    row |= _fields(fields)
                block = int(fields["content-length"])
                total += len(data)
                data = data[: max(0, block - (total - len(data)))]
                if http is not None:
                    http += data
                    cut = http.find(_HEADER_END)
                    if cut < 0:
                        continue
                    data, http = http[cut + 4 :], None
                digest.update(data)
                length += len(data)
                if self.keep:
                    kept.append(data)
        except zlib.error as error:
            return None if fields is None else row | {"end": at, "error": str(error)}
        if fields is None:
            return None
        error = None if total == int(fields["content-length"]) + 4 else f"the block has {total - 4} bytes of {fields['content-length']}"
        return row | {"end": end, "payload_bytes": length, "payload_digest": _base32(digest.digest()), "error": error, "payload": b"".join(kept) if self.keep else None}

    def records(self) -> Iterator[dict]:
        at = self._candidate(self.start)
        while at < self.end:
            row = self._record(at)
            if row is not None:
                yield row
            at = self._candidate(row["end"] if row is not None and row["end"] > at else at + 1)
        self.source.close()


def _fields(fields: dict[str, str]) -> dict:
    page = fields.get("x-page-id", "")
    bare = lambda name: re.sub("^<urn:uuid:|>$", "", fields[name]) if name in fields else None
    return {
        "record_id": bare("warc-record-id"), "record_type": fields["warc-type"], "target_uri": fields.get("warc-target-uri"), "page_id": int(page) if re.fullmatch("-?[0-9]+", page) else None,
        "refers_to_id": bare("warc-refers-to"), "stated_digest": fields["warc-payload-digest"].partition(":")[2] if "warc-payload-digest" in fields else None,
    }


def _reader(keep_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for part in batch.to_pylist():
                for row in _Range(part["file"], part["start"], part["end"], keep_payload).records():
                    rows.append(row)
                    held += len(row.get("payload") or b"")
                    if held >= _BATCH_BYTES or len(rows) >= _BATCH_ROWS:
                        yield pa.RecordBatch.from_pylist(rows, schema=_RECORD_TYPES)
                        rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=_RECORD_TYPES)

    return read


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, n_bytes) of the archives under a path or pattern; their contents are not read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("n_bytes"))


def read_warc(files: DataFrame, split_bytes: int = SPLIT_BYTES, payload: bool = True) -> DataFrame:
    """The records (RECORDS) of the archives in `files` (file, n_bytes), as each byte range finds them.

    payload_bytes and payload_digest (bare base32 SHA-1) are taken from what is read. A damaged record has an error
    and goes no further than its start. Empty files and tables have no records. Pass a table of all records that is
    written out to `settled` to be rid of members of archives inside records.
    """
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start")
    ranges = files.where("n_bytes > 0").select("file", "n_bytes", starts).select("file", "start", F.least(F.col("start") + split_bytes, F.col("n_bytes")).alias("end"))
    # Rows of a few bytes stand for ranges of many: their number is set, or else they would be put together by their size.
    tasks = files.where("n_bytes > 0").agg(F.sum(F.ceil(F.col("n_bytes") / split_bytes))).first()[0] or 1
    return ranges.repartition(min(MOST_TASKS, int(tasks))).mapInArrow(_reader(payload), RECORDS)


def settled(records: DataFrame) -> DataFrame:
    """The records that lie in no other one. `records` is evaluated twice."""
    ends = records.groupBy("file", "split").agg(F.max("end").alias("last"), F.min("start").alias("first"))
    before = F.max("last").over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1))
    crossed = ends.select("file", "split", "first", before.alias("floor")).where("floor > first").select("file", "split", "floor")
    return records.join(crossed, ["file", "split"], "left").where("floor IS NULL OR start >= floor").select(*records.columns)


def resolved(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of responses and revisits; a revisit has the
    size and digest of the response it refers to, and its page_id."""
    found = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("to_page"), F.col("payload_bytes").alias("to_bytes"), F.col("payload_digest").alias("to_digest"))
    rows = records.where("record_type IN ('response', 'revisit')").join(found, "refers_to_id", "left")
    revisit = F.col("record_type") == "revisit"
    return rows.select(
        "page_id", F.when(revisit, F.col("to_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), F.when(revisit, F.coalesce("to_digest", "stated_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", F.when(revisit, F.col("to_page")).alias("refers_to"),
    )


def archived(pages: DataFrame, folder: str, least_bytes: int = 0, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The rows of resolved() for `pages` (page_id, url, html; other columns are ignored), written to archives in `folder`
    and read back.

    Every row has a record, also with a null page_id, url or html and if it repeats another; ties are as in warc_records.
    Payloads may be of any length; an empty table writes nothing and gives an empty result.
    """
    files = write_warc(warc_records(pages, least_bytes), folder)
    return resolved(settled(checkpointed(read_warc(files, split_bytes, payload=False).drop("payload"))))


def op13_warc(spark, sf_dir: str) -> DataFrame:
    """archived() over all of `pages`, in the session's shared folder; its edge cases hold."""
    return archived(table(spark, sf_dir, "pages"), f"{shared_folder(spark)}/warc-{uuid.uuid4()}")


OP13_SQL = """
WITH hashed AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST, encode(url) DESC NULLS LAST) AS place, max(page_id) OVER (PARTITION BY html) AS top FROM hashed)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(h, 5 * (k // 4) + 1, 5))::BIGINT >> (15 - 5 * (k % 4))) % 32 + 1)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN top END AS refers_to
FROM ranked
"""
