import hashlib
import random
import zlib

import numpy as np
import pytest

from tallyspark.llm.flac import BLOCK, FlacError, decode, digest, encode, pcm_blocks, store


def streams(payloads):
    sizes = np.array([len(p) for p in payloads])
    return encode(np.frombuffer(b"".join(payloads), np.uint8), sizes)


def payloads(seed=1):
    rng = random.Random(seed)
    out = [bytes(64), b"a" * 1024, bytes(range(256)) * 12]
    out.append(bytes(int(128 + 100 * np.sin(i / 9)) for i in range(6400)))
    out.append((b"the quick brown fox jumps over the lazy dog " * 400)[:16000])
    out.append(rng.randbytes(5 * BLOCK + 64))
    out.append((b"\x80" * 900 + b"\xff\x00" * 62) * 3)
    for _ in range(30):
        n = rng.randint(1, 60) * 64
        out.append(bytes(rng.choices(b"abcde \n", k=n)))
    return out


def test_round_trip_with_and_without_seek_table():
    every = payloads()
    media = streams(every)
    assert [d.payload for d in decode(media)] == every
    plain = []
    for m in media:
        size = int.from_bytes(m[43:46], "big")
        plain.append(m[:4] + b"\x80" + m[5:42] + m[46 + size :])
    assert [d.payload for d in decode(plain)] == every
    kinds = np.concatenate([d.kinds for d in decode(media)])
    assert set(kinds.tolist()) == {0, 1, 2, 3}


def test_seek_offsets():
    every = payloads()
    for m, d in zip(streams(every), decode(streams(every)), strict=True):
        assert all(m[p : p + 2] == b"\xff\xf8" for p in d.places.tolist())
        assert d.offsets.tolist() == list(range(0, len(d.payload), BLOCK))


def test_damage_is_noticed():
    media = streams([payloads()[4]])[0]
    rng = random.Random(2)
    for _ in range(60):
        at = rng.randrange(60, len(media))
        bad = bytearray(media)
        bad[at] ^= 1 << rng.randrange(8)
        try:
            same = decode([bytes(bad)])[0].payload == payloads()[4]
        except FlacError:
            continue
        assert same and at < 46 + int.from_bytes(media[43:46], "big")  # only the seek table may hide damage


def test_reads_partitions_escapes_and_fixed_orders():
    """A frame written by hand: fixed order 2, four partitions, one of them escaped to raw residuals."""
    from tallyspark.llm.flac import _CRC8, _CRC16, decode_frames, Lanes

    rng = random.Random(7)
    samples = [rng.randint(-20, 20) for _ in range(192)]
    residual = [samples[i] - 2 * samples[i - 1] + samples[i - 2] for i in range(2, 192)]
    bits = "0" + f"{8 + 2:06b}" + "0" + "".join(f"{s & 255:08b}" for s in samples[:2]) + "00" + f"{2:04b}"
    at = 0
    for part, size in enumerate((46, 48, 48, 48)):
        own, at = residual[at : at + size], at + size
        if part == 1:
            bits += "1111" + f"{9:05b}" + "".join(f"{r & 511:09b}" for r in own)
            continue
        k = (5, 0, 0, 3)[part]
        bits += f"{k:04b}"
        for r in own:
            u = 2 * r if r >= 0 else -2 * r - 1
            bits += "0" * (u >> k) + "1" + (f"{u & ((1 << k) - 1):0{k}b}" if k else "")
    bits += "0" * (-len(bits) % 8)
    head = bytes([0xFF, 0xF8, 0x10, 0x02, 0x00])
    crc = 0
    for b in head:
        crc = int(_CRC8[crc ^ b])
    frame = head + bytes([crc]) + int(bits, 2).to_bytes(len(bits) // 8, "big")
    crc = 0
    for b in frame:
        crc = ((crc << 8) & 0xFFFF) ^ int(_CRC16[(crc >> 8) ^ b])
    frame += crc.to_bytes(2, "big")
    got = decode_frames(Lanes(np.frombuffer(frame + bytes(8), np.uint8)), np.zeros(1, np.int64))
    assert got.samples[:192, 0].tolist() == samples and got.end[0] == len(frame)


def test_columns(spark):
    texts = ["", None, "hello", "é" * 700, "x y " * 9000, "hello"]
    df = spark.createDataFrame([(i, t, b"m") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    stored = store(df)
    rows = {r.doc_id: r for r in digest(stored).collect()}
    blocks = {}
    for r in pcm_blocks(stored).orderBy("doc_id", "block").collect():
        assert r.sample_offset == len(blocks.get(r.doc_id, b""))
        blocks[r.doc_id] = blocks.get(r.doc_id, b"") + bytes(r.pcm)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert blocks[i] == padded
    assert rows[2][1:] == rows[5][1:]


def test_bad_streams():
    for bad in (b"", b"nope", b"fLaC", b"fLaC\x80\x00\x00\x00"):
        with pytest.raises(FlacError):
            decode([bad])


def test_long_payload_is_coded_in_runs():
    import tracemalloc

    rng = np.random.default_rng(3)
    text = np.frombuffer((" ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 500_000).tolist())).encode()[: 5 << 19], np.uint8)
    tracemalloc.start()
    media = encode(text, np.array([text.size]))
    back = decode(media)[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert back.payload == text.tobytes() and back.offsets.tolist() == list(range(0, text.size, BLOCK))
    assert peak < 160 << 20
    some = [text[:100], text[: 1 << 21], text[:64], text[: (1 << 20) + 1]]
    streams = encode(np.concatenate(some), np.array([x.size for x in some]))
    assert streams == [encode(x, np.array([x.size]))[0] for x in some]
    assert [d.payload for d in decode(streams)] == [x.tobytes() for x in some]


def test_damaged_rows_are_set_apart(spark):
    good = store(spark.createDataFrame([(1, "abc " * 400), (2, "def " * 400), (3, None)], "doc_id long, text string")).collect()
    rows = [(r.doc_id, r.n_bytes, bytes(r.media[:-3]) + bytes(3) if r.doc_id == 2 else bytes(r.media)) for r in good] + [(4, 0, None)]
    table = spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in digest(table).collect()}
    assert sorted(got) == [1, 2, 3]
    assert got[2].error and got[2].payload_sha256 is None and got[1].error is None and got[3].payload_bytes == 64
    assert {r.doc_id for r in pcm_blocks(table).collect()} == {1, 3}
    assert digest(table.limit(0)).count() == 0
