import base64
import gzip
import hashlib
import random
import zlib

import pytest

from tallyspark.llm import warc
from tallyspark.llm.warc import archive_files, archived, read_warc, settled, warc_records, write_warc

SCHEMA = "page_id long, url string, html string, sha string, best string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def expected(rows, least=0):
    """Sorted rows; of rows that repeat the response in everything one is the response."""
    groups = {}
    for page_id, url, html in rows:
        groups.setdefault((html or "").encode(), []).append((page_id is not None, page_id or 0, url is not None, url or ""))
    out = []
    for data, own in groups.items():
        own.sort(reverse=True)
        for k, (known, page_id, _, _) in enumerate(own):
            first = k == 0 or len(data) < least
            top = own[0][1] if own[0][0] else None
            out.append((page_id if known else None, len(data), b32(data), "response" if first else "revisit", None if first else top))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in df.collect()), key=str)


PAGES = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, "http://a/\r\nX-Page-ID: 9", "<p>ünique</p>"), (4, None, None), (5, "http://a/5", ""),
    (None, "http://a/6", "<p>one</p>"), (7, "http://a/7", "repeated row"), (7, "http://a/7", "repeated row"), (7, "http://a/7", "repeated row"), (6, "http://a/7", "repeated row"),
    (None, None, "no id"), (None, "http://a", "no id"), (8, "http://b/8", "\r\n\r\nWARC/1.1\r\n" * 500), (9, "http://b/9", "x" * 3_000_000),
]


@pytest.mark.parametrize(("least", "split"), [(0, 32 << 20), (0, 200), (11, 1000)])
def test_round_trip(spark, tmp_path, least, split):
    pages = PAGES + [(100 + i, f"http://c/{i}", "".join(random.Random(i % 40).choices("abcdef<>é", k=i % 40 * 30))) for i in range(200)]
    assert got(archived(frame(spark, pages).repartition(3), str(tmp_path / "out"), least, split)) == expected(pages, least)


def test_files_are_warc_members(spark, tmp_path):
    """Read by the standard library alone: each member one record with a length that holds and its own digest."""
    files = write_warc(warc_records(frame(spark, PAGES)), str(tmp_path / "out"), file_bytes=2000).collect()
    seen = 0
    for f in files:
        data = open(f.file.removeprefix("file:"), "rb").read()
        assert len(data) == f.n_bytes
        while data:
            unpacker = zlib.decompressobj(31)
            record = unpacker.decompress(data)
            data = unpacker.unused_data
            head, _, rest = record.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            block = rest[: int(fields["Content-Length"])]
            assert rest[len(block) :] == b"\r\n\r\n" and len(block) == int(fields["Content-Length"])
            if fields["WARC-Type"] == "response":
                assert fields["WARC-Payload-Digest"] == "sha1:" + b32(block.partition(b"\r\n\r\n")[2])
            else:
                assert not block and fields["WARC-Refers-To"].startswith("<urn:uuid:")
            seen += 1
    assert seen == len(PAGES) == sum(f.n_records for f in files)


def member(kind, payload, level=6, **fields):
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{b32(payload)}>", "Content-Length": len(payload), **fields}
    return gzip.compress(("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + payload + b"\r\n\r\n", level)


@pytest.mark.parametrize("split", [50, 333, 1 << 20])
def test_archive_inside_a_record(spark, tmp_path, split):
    """Deflate stores an archive as it is, so ranges find its members too; they are no records of the outer archive."""
    rng = random.Random(2)
    inner = b"".join(member("resource", rng.randbytes(300)) for _ in range(12))
    outer = [b"before " * 20, inner, b"after", rng.randbytes(500) + inner[:-1], b"last"]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(member("resource", p, level=0) for p in outer))
    found = read_warc(archive_files(spark, str(tmp_path)), split)
    kept = sorted(settled(found).collect(), key=lambda r: r.start)
    assert [r.payload for r in kept] == outer and all(r.error is None for r in kept)
    assert [r.end for r in kept[:-1]] == [r.start for r in kept[1:]]
    if split == 50:
        assert found.count() > len(outer)


def test_damage_and_padding(spark, tmp_path):
    good = [member("resource", f"record {i} ".encode() * 50) for i in range(6)]
    broken = bytearray(member("resource", b"broken " + random.Random(1).randbytes(400)))
    broken[-60] ^= 255
    short = member("resource", b"abc", **{"Content-Length": 9})
    data = good[0] + b"\0" * 30 + b"\x1f\x8b\x08 no member" + good[1] + bytes(broken) + good[2] + gzip.compress(b"no record at all") + short + good[3] + good[4][:-9]
    (tmp_path / "x.warc.gz").write_bytes(data)
    (tmp_path / "y.warc.gz").write_bytes(b"")
    for split in (37, 1 << 20):
        rows = settled(read_warc(archive_files(spark, str(tmp_path)), split)).collect()
        assert sorted(r.payload for r in rows if r.error is None) == [f"record {i} ".encode() * 50 for i in range(4)]
        assert len([r for r in rows if r.error is not None]) == 3


def test_http_payload_and_digest_of_foreign_records(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + b"body\r\n\r\nmore"
    (tmp_path / "x.warc.gz").write_bytes(member("warcinfo", b"software: x") + member("response", http, **{"Content-Type": "application/http; msgtype=response"}))
    rows = {r.record_type: r for r in read_warc(archive_files(spark, str(tmp_path))).collect()}
    assert rows["response"].payload == b"body\r\n\r\nmore" and rows["response"].payload_digest == b32(b"body\r\n\r\nmore")
    assert rows["warcinfo"].payload == b"software: x" and rows["warcinfo"].page_id is None


def test_empty_table(spark, tmp_path):
    assert got(archived(frame(spark, []), str(tmp_path / "out"))) == []


def test_long_payload_is_read_in_parts(spark, tmp_path):
    """64 MB of html: the reader holds a few chunks of it when only its digest is asked for."""
    import tracemalloc

    html = "".join(random.Random(4).choices("abcdefgh <>", k=1 << 20)) * 64
    files = write_warc(warc_records(frame(spark, [(1, "u", html)])), str(tmp_path / "out")).collect()
    tracemalloc.start()
    rows = list(warc._Range(files[0].file, 0, files[0].n_bytes, False).records())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20 and [(r["payload_bytes"], r["payload_digest"]) for r in rows] == [(len(html), b32(html.encode()))]
