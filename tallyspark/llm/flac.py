"""Media columns: bytes stored as 8-bit mono FLAC, decoded with all checks, and cut into seekable PCM blocks.

Tasks work on many frames at once: a numpy lane is a frame, and one step decodes one residual of every lane. The seek
table has a point for each frame, so all frames of a batch start together; without one, each stream's frames follow
one another and the lanes are the streams.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_blocks

UNIT = 64
BLOCK = 1024
RATE = 8000
LPC_ORDER = 8
LPC_BITS = 12
MOST_RICE = 14
BATCH_BYTES = 1 << 20
#: Samples of a long payload that are encoded, and frames that are decoded, at a time.
RUN = 1 << 20
FRAMES_AT_A_TIME = 1 << 11

CONSTANT, VERBATIM, FIXED, LPC = range(4)
KIND_NAMES = ("constant", "verbatim", "fixed", "lpc")
#: Coefficients of the fixed predictors, newest sample first.
_FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


class FlacError(ValueError):
    """A stream that is no FLAC of this kind, or whose checksums don't hold."""


def _crc_table(polynomial: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = []
    for byte in range(256):
        c = byte << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ polynomial if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, np.int64)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
#: Leading zeros of 16-bit values; 16 for zero.
_ZEROS = np.array([16 - x.bit_length() for x in range(1 << 16)], np.int64)


def _crc(data: np.ndarray, start: np.ndarray, size: np.ndarray, bits: int) -> np.ndarray:
    """CRC-8 or CRC-16 of many byte ranges, one step for a byte of each."""
    order = np.argsort(-size, kind="stable")
    at, crc = start[order], np.zeros(start.size, np.int64)
    ends = np.searchsorted(-size[order], -np.arange(1, (size.max(initial=0)) + 1), side="right")
    for step, n in enumerate(ends.tolist()):
        byte = data[at[:n] + step]
        crc[:n] = _CRC8[crc[:n] ^ byte] if bits == 8 else ((crc[:n] << 8) & 0xFFFF) ^ _CRC16[(crc[:n] >> 8) ^ byte]
    out = np.empty_like(crc)
    out[order] = crc
    return out


# --- encoding ---------------------------------------------------------------------------------------------------


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def _rice(u: np.ndarray, inside: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A Rice parameter for each frame and the bits of its residuals."""
    total = np.where(inside, u, 0).sum(axis=1, dtype=np.int64)
    guess = np.log2(np.maximum(total / np.maximum(count, 1) * np.log(2), 1e-9))
    k = np.clip(np.round(guess), 0, MOST_RICE).astype(np.int64)
    return k, np.where(inside, u >> k[:, None].astype(u.dtype), 0).sum(axis=1, dtype=np.int64) + count * (k + 1)


def _lpc(x: np.ndarray, inside: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(residuals, quantised coefficients, shifts) of the linear predictors of LPC_ORDER."""
    n = x.shape[1]
    place = (np.arange(n) - (size[:, None] - 1) / 2) / ((size[:, None] + 1) / 2)
    windowed = np.where(inside, x * (1 - place**2), 0.0)
    r = np.stack([(windowed[:, : n - lag] * windowed[:, lag:]).sum(axis=1) for lag in range(LPC_ORDER + 1)], axis=1)
    a, error = np.zeros((len(x), LPC_ORDER)), r[:, 0] * (1 + 1e-9) + 1e-9
    for i in range(LPC_ORDER):
        reflection = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(axis=1)) / error
        new = a.copy()
        new[:, :i] = a[:, :i] - reflection[:, None] * a[:, :i][:, ::-1]
        new[:, i] = reflection
        a, error = new, np.maximum(error * (1 - reflection**2), 1e-9)
    largest = np.maximum(np.abs(a).max(axis=1), 1e-9)
    shift = np.clip(LPC_BITS - 2 - np.floor(np.log2(largest)).astype(np.int64), 0, 15)
    limit = 1 << (LPC_BITS - 1)
    q = np.clip(np.round(a * (1 << shift)[:, None]), -limit, limit - 1).astype(np.int32)
    predicted = np.zeros_like(x)
    for j in range(LPC_ORDER):
        predicted[:, j + 1 :] += q[:, j : j + 1] * x[:, : n - j - 1]
    return x - (predicted >> shift[:, None].astype(np.int32)), q, shift


def _coded_number(n: int) -> bytes:
    """A frame number in the format's UTF-8-like form."""
    if n < 0x80:
        return bytes([n])
    size = next(s for s in range(2, 8) if n < 1 << (5 * s + 1))
    tail = [0x80 | (n >> (6 * i)) & 0x3F for i in range(size - 2, -1, -1)]
    return bytes([(0xFF00 >> size) & 0xFF | n >> (6 * (size - 1)), *tail])


def _put(bits: np.ndarray, at: np.ndarray, values: np.ndarray, width: int) -> None:
    for j in range(width):
        bits[at + j] = (values >> (width - 1 - j)) & 1


def encode(payload: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """FLAC streams of consecutive payloads of the given positive sizes; sample = byte - 128. A payload of more than RUN
    samples is encoded in runs of frames."""
    out, end = [], np.cumsum(sizes)
    begin = end - sizes
    first = 0
    while first < sizes.size:
        if sizes[first] > RUN:
            own = payload[begin[first] : end[first]]
            runs = [_encode_frames(own[at : at + RUN], np.array([min(RUN, own.size - at)]), at // BLOCK) for at in range(0, own.size, RUN)]
            out.append(_stream(own, np.concatenate([r[1] for r in runs]), b"".join(r[0] for r in runs)))
            first += 1
            continue
        stop = first
        while stop < sizes.size and sizes[stop] <= RUN:
            stop += 1
        raw, frame_bytes = _encode_frames(payload[begin[first] : end[stop - 1]], sizes[first:stop], 0)
        bound, place = np.r_[0, np.cumsum(-(-sizes[first:stop] // BLOCK))], np.r_[0, np.cumsum(frame_bytes)]
        for i in range(first, stop):
            a, b = bound[i - first], bound[i - first + 1]
            out.append(_stream(payload[begin[i] : end[i]], frame_bytes[a:b], raw[place[a] : place[b]]))
        first = stop
    return out


def _stream(payload: np.ndarray, frame_bytes: np.ndarray, frames: bytes) -> bytes:
    """The metadata with a seek point for each frame, and the frames."""
    n = payload.size
    table = np.zeros(frame_bytes.size, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")]))
    table["sample"] = np.arange(frame_bytes.size) * BLOCK
    table["offset"] = np.cumsum(frame_bytes) - frame_bytes
    table["size"] = np.minimum(BLOCK, n - np.arange(frame_bytes.size) * BLOCK)
    packed = RATE << 44 | 7 << 36 | n
    info = BLOCK.to_bytes(2, "big") * 2 + int(frame_bytes.min()).to_bytes(3, "big") + int(frame_bytes.max()).to_bytes(3, "big") + packed.to_bytes(8, "big") + hashlib.md5((payload ^ 0x80).tobytes()).digest()
    seek = table.tobytes()
    if len(seek) >= 1 << 24:  # a metadata block has no room for it; such a stream is read frame by frame
        return b"fLaC\x80\x00\x00\x22" + info + frames
    return b"fLaC\x00\x00\x00\x22" + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + frames


def _encode_frames(payload: np.ndarray, sizes: np.ndarray, first_number: int) -> tuple[bytes, np.ndarray]:
    """The frames of consecutive payloads, and the bytes of each; numbers begin at first_number."""
    frames = -(-sizes // BLOCK)
    total = int(frames.sum())
    number = np.arange(total) - np.repeat(np.cumsum(frames) - frames, frames)
    begin = np.repeat(np.cumsum(sizes) - sizes, frames) + number * BLOCK
    size = np.minimum(BLOCK, np.repeat(sizes, frames) - number * BLOCK)
    column = np.arange(BLOCK)
    inside = column < size[:, None]
    x = np.where(inside, payload[np.minimum(begin[:, None] + column, payload.size - 1)].astype(np.int32) - 128, 0).astype(np.int32)

    kind, order = np.full(total, VERBATIM), np.zeros(total, np.int64)
    best = size * 8
    rice = np.zeros(total, np.int64)
    chosen = np.zeros_like(x)
    residual = x
    lpc_residual, coefficients, shift = _lpc(x, inside, size)
    for o in range(4):
        if o == 3:
            residual, o = lpc_residual, LPC_ORDER
        elif o:
            residual = np.concatenate([residual[:, :1], np.diff(residual, axis=1)], axis=1)
        u = _zigzag(residual)
        used = inside & (column >= o)
        k, cost = _rice(u, used, np.maximum(size - o, 0))
        cost = cost + 10 + 8 * o + (9 + LPC_BITS * LPC_ORDER if o == LPC_ORDER else 0)
        better = (cost < best) & (size > o)
        kind[better] = LPC if o == LPC_ORDER else FIXED
        order[better], best[better], rice[better] = o, cost[better], k[better]
        chosen[better] = u[better]
    same = np.where(inside, x != x[:, :1], False).any(axis=1)
    kind[~same], best[~same] = CONSTANT, 8
    order[kind <= VERBATIM] = 0

    number = number + first_number
    number_bytes = {n: _coded_number(n) for n in range(first_number, first_number + int(frames.max(initial=0)))}
    heads = []
    for n, s in zip(number.tolist(), size.tolist(), strict=True):
        full = s == BLOCK
        heads.append(b"\xff\xf8" + (b"\xa0\x02" if full else b"\x70\x02") + number_bytes[n] + (b"" if full else (s - 1).to_bytes(2, "big")))
    head_size = np.array([len(h) for h in heads], np.int64)
    frame_bytes = head_size + 1 + -(-(8 + best) // 8) + 2
    start = np.cumsum(frame_bytes) - frame_bytes
    bits = np.zeros(int(frame_bytes.sum()) * 8, np.uint8)
    at = (start + head_size + 1) * 8
    code = np.choose(kind, [0, 1, 8 + order, 32 + order - 1])
    _put(bits, at, code << 1, 8)
    at = at + 8
    constant = kind == CONSTANT
    _put(bits, at[constant], x[constant, 0], 8)
    for j in np.flatnonzero(kind == VERBATIM).tolist():
        bits[at[j] : at[j] + 8 * size[j]] = np.unpackbits((x[j, : size[j]] & 0xFF).astype(np.uint8))
    coded = np.flatnonzero(kind >= FIXED)
    at = at[coded]
    for j in range(LPC_ORDER):
        warm = order[coded] > j
        _put(bits, at[warm] + 8 * j, x[coded[warm], j], 8)
    at = at + 8 * order[coded]
    linear = kind[coded] == LPC
    own = coded[linear]
    _put(bits, at[linear], np.full(own.size, LPC_BITS - 1), 4)
    _put(bits, at[linear] + 4, shift[own], 5)
    for j in range(LPC_ORDER):
        _put(bits, at[linear] + 9 + LPC_BITS * j, coefficients[own, j], LPC_BITS)
    at[linear] += 9 + LPC_BITS * LPC_ORDER
    _put(bits, at + 6, rice[coded], 4)  # Rice coding, one partition
    used = inside[coded] & (column >= order[coded][:, None])
    u = chosen[coded][used].astype(np.int64)
    lane = np.repeat(np.arange(coded.size), used.sum(axis=1))
    k = rice[coded][lane]
    quotient = u >> k
    length = quotient + k + 1
    ends = np.cumsum(length)
    first = np.searchsorted(lane, np.arange(coded.size))
    before = np.r_[0, ends][first]
    stop = ends - length - before[lane] + at[lane] + 10 + quotient
    bits[stop] = 1
    for j in range(int(k.max(initial=0))):
        more = k > j
        bits[stop[more] + 1 + j] = (u[more] >> (k[more] - 1 - j)) & 1
    data = np.packbits(bits)
    head_at = np.repeat(start, head_size) + np.arange(head_size.sum()) - np.repeat(np.cumsum(head_size) - head_size, head_size)
    data[head_at] = np.frombuffer(b"".join(heads), np.uint8)
    data[start + head_size] = _crc(data, start, head_size, 8)
    check = _crc(data, start, frame_bytes - 2, 16)
    data[start + frame_bytes - 2], data[start + frame_bytes - 1] = check >> 8, check & 0xFF

    return data.tobytes(), frame_bytes


# --- decoding ---------------------------------------------------------------------------------------------------


@dataclass
class Stream:
    """What the metadata says; offsets count from the first byte of the stream."""

    samples: int
    md5: bytes
    audio: int
    points: np.ndarray  # byte offsets of the frames, empty without a seek table


def read_metadata(media: bytes) -> Stream:
    if media[:4] != b"fLaC":
        raise FlacError("no stream marker")
    at, info, points, last = 4, None, np.zeros(0, np.int64), False
    while not last:
        if at + 4 > len(media):
            raise FlacError("metadata ends early")
        last, kind, size = media[at] >> 7, media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4], "big")
        body = media[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            if (packed >> 41) & 7 or (packed >> 36) & 31 != 7:
                raise FlacError("only 8-bit mono streams")
            info = packed & (1 << 36) - 1, body[18:34]
        elif kind == 3:
            table = np.frombuffer(body, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")]))
            table = table[table["sample"] != 2**64 - 1]
            # It helps only if it names every frame.
            if info and table.size and (np.r_[table["sample"][1:], info[0]].astype(np.int64) - table["sample"].astype(np.int64) == table["size"]).all():
                points = table["offset"].astype(np.int64)
    if info is None:
        raise FlacError("no stream information")
    return Stream(info[0], info[1], at, points + at)


class Lanes:
    """Bits of one buffer at many places at once."""

    def __init__(self, data: np.ndarray) -> None:
        self.data = data = np.r_[data, np.zeros(16, np.uint8)]
        self.words = np.zeros(data.size - 8, np.uint64)
        for j in range(8):
            self.words |= data[j : data.size - 8 + j].astype(np.uint64) << np.uint64(56 - 8 * j)

    def at(self, place: np.ndarray) -> np.ndarray:
        """At least 57 bits from each bit place on, left-aligned."""
        return self.words[np.minimum(place >> 3, self.words.size - 1)] << (place & 7).astype(np.uint64)

    def read(self, place: np.ndarray, width: int | np.ndarray) -> np.ndarray:
        """Unsigned values of 0 to 32 bits."""
        return ((self.at(place) >> np.uint64(1)) >> (63 - np.asarray(width)).astype(np.uint64)).astype(np.int64)

    def signed(self, place: np.ndarray, width: int | np.ndarray) -> np.ndarray:
        value = self.read(place, width)
        half = np.where(np.asarray(width) > 0, np.left_shift(1, np.maximum(np.asarray(width) - 1, 0)), 1)
        return value - np.where(value >= half, half << 1, 0)


def _residuals(lanes: Lanes, at: np.ndarray, count: np.ndarray, block: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[steps, lanes] residuals in partitions of Rice codes, and the bit after each lane's last."""
    method = lanes.read(at, 2)
    if (method > 1).any():
        raise FlacError("unknown residual coding")
    width = 4 + method
    partition = block >> lanes.read(at + 2, 4)
    place = at + 6
    by_count = np.argsort(-count, kind="stable")
    place, width, partition, order, count = (v[by_count] for v in (place, width, partition, order, count))
    if (partition <= order).any():
        raise FlacError("a partition is shorter than its predictor")
    k, raw = np.zeros(at.size, np.int64), np.full(at.size, -1)
    following = np.zeros(at.size, np.int64)
    steps = int(count.max(initial=0))
    out = np.zeros((steps, at.size), np.int64)
    active = np.searchsorted(-count, -np.arange(1, steps + 1), side="right").tolist()
    next_read, any_raw = 0, False
    for step in range(steps):
        n = active[step]
        if step == next_read:
            due = np.flatnonzero(following[:n] == step)
            k[due] = lanes.read(place[due], width[due])
            place[due] += width[due]
            escape = k[due] == (1 << width[due]) - 1
            raw[due] = np.where(escape, lanes.read(place[due], 5), -1)
            place[due[escape]] += 5
            following[due] = step + partition[due] - np.where(step == 0, order[due], 0)
            next_read = int(following[:n].min())
            any_raw = bool((raw[:n] >= 0).any())
        p = place[:n]
        word = lanes.at(p)
        q = _ZEROS[(word >> np.uint64(48)).astype(np.int64)]
        if q.max(initial=0) == 16:
            for i in np.flatnonzero((q == 16) & (raw[:n] < 0)).tolist():
                run = 0
                while not lanes.read(p[i : i + 1] + run, 1)[0]:
                    run += 1
                    if (p[i] + run) >> 3 >= lanes.data.size:
                        raise FlacError("a code does not end")
                q[i] = run
                word[i] = lanes.at(p[i : i + 1] + run)[0] >> np.uint64(1) << np.uint64(1)
        kk = k[:n]
        shift = np.where(q > 15, 1, q + 1).astype(np.uint64)
        low = ((word << shift) >> np.uint64(1)) >> (63 - kk).astype(np.uint64)
        u = (q << kk) | low.astype(np.int64)
        value = (u >> 1) ^ -(u & 1)
        used = q + 1 + kk
        if any_raw:
            plain = np.flatnonzero(raw[:n] >= 0)
            value[plain] = lanes.signed(p[plain], raw[plain])
            used[plain] = raw[plain]
        out[step, :n] = value
        place[:n] += used
    back = np.empty_like(by_count)
    back[by_count] = np.arange(by_count.size)
    return out[:, back], place[back]


@dataclass
class Frames:
    samples: np.ndarray  # [most samples, frames]
    size: np.ndarray
    number: np.ndarray
    end: np.ndarray
    kind: np.ndarray


def decode_frames(lanes: Lanes, start: np.ndarray) -> Frames:
    """Decodes the frames at the given bytes and verifies their CRC-8 and CRC-16."""
    data, n = lanes.data, start.size
    byte = lambda k: data[np.minimum(start + k, data.size - 1)].astype(np.int64)
    if ((byte(0) != 0xFF) | (byte(1) & 0xFE != 0xF8)).any():
        raise FlacError("no frame where one should start")
    size_code, rate_code, layout = byte(2) >> 4, byte(2) & 15, byte(3)
    if ((layout >> 4 != 0) | ~np.isin(layout >> 1 & 7, (0, 1))).any():
        raise FlacError("only 8-bit mono frames")
    lead = byte(4)
    extra = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [0, 1, 2, 3, 4, 5], 6)
    number = np.where(extra == 0, lead, lead & (0x3F >> extra))
    for j in range(1, 7):
        number = np.where(extra >= j, number << 6 | byte(4 + j) & 0x3F, number)
    at = 5 + extra
    size = np.select([size_code == 1, (size_code >= 2) & (size_code <= 5), size_code == 6, size_code == 7, size_code >= 8],
                     [192, 576 << np.maximum(size_code - 2, 0), byte(at) + 1, (byte(at) << 8 | byte(at + 1)) + 1, 256 << np.maximum(size_code - 8, 0)], 0)
    at = at + np.select([size_code == 6, size_code == 7], [1, 2], 0)
    at = at + np.select([rate_code == 12, (rate_code == 13) | (rate_code == 14)], [1, 2], 0)
    if (_crc(data, start, at, 8) != byte(at)).any():
        raise FlacError("a frame header's checksum does not hold")
    place = (start + at + 1) * 8
    head = lanes.read(place, 8)
    code = head >> 1
    if (head & 1 | head >> 7).any():
        raise FlacError("unused or reserved subframe bits are set")
    kind = np.select([code == 0, code == 1, (code >= 8) & (code <= 12), code >= 32], [CONSTANT, VERBATIM, FIXED, LPC], -1)
    if (kind < 0).any():
        raise FlacError("unknown subframe")
    order = np.select([kind == FIXED, kind == LPC], [code - 8, code - 31], 0)
    place = place + 8
    samples = np.zeros((int(size.max(initial=0)), n), np.int64)
    end = place.copy()
    for j in np.flatnonzero(kind == CONSTANT):
        samples[: size[j], j] = lanes.signed(place[j : j + 1], 8)[0]
        end[j] = place[j] + 8
    for j in np.flatnonzero(kind == VERBATIM):
        samples[: size[j], j] = data[place[j] >> 3 : (place[j] >> 3) + size[j]].view(np.int8)
        end[j] = place[j] + 8 * size[j]
    coded = np.flatnonzero(kind >= FIXED)
    if coded.size:
        at, own = place[coded], order[coded]
        for j in range(int(own.max())):
            warm = own > j
            samples[j, coded[warm]] = lanes.signed(at[warm] + 8 * j, 8)
        at = at + 8 * own
        linear = kind[coded] == LPC
        precision = np.where(linear, lanes.read(at, 4) + 1, 0)
        shift = np.where(linear, lanes.signed(at + 4, 5), 0)
        if ((precision == 16) | (shift < 0)).any():
            raise FlacError("invalid predictor")
        weights = np.zeros((int(own.max()), coded.size), np.int64)
        for j in range(weights.shape[0]):
            use = linear & (own > j)
            weights[j, use] = lanes.signed(at[use] + 9 + precision[use] * j, precision[use])
            for o in range(j + 1, 5):
                weights[j, ~linear & (own == o)] = _FIXED[o][j]
        at = at + np.where(linear, 9 + precision * own, 0)
        residual, end[coded] = _residuals(lanes, at, size[coded] - own, size[coded], own)
        for o in np.unique(own).tolist():
            pick = np.flatnonzero(own == o)
            columns, r = coded[pick], residual[:, pick]
            if o == 0:
                samples[: r.shape[0], columns] = r[: samples.shape[0]]
                continue
            s = np.zeros((o + r.shape[0], pick.size), np.int64)
            s[:o] = samples[:o, columns]
            newest_last = np.ascontiguousarray(weights[:o, pick][::-1])
            for t in range(int((size[columns] - o).max())):
                s[o + t] = (np.einsum("ol,ol->l", newest_last, s[t : t + o]) >> shift[pick]) + r[t]
            rows = min(samples.shape[0], s.shape[0])
            samples[:rows, columns] = s[:rows]
    end = (end + 7) >> 3
    if (end + 2 > data.size - 16).any() or (_crc(data, start, end - start, 16) != (data[end].astype(np.int64) << 8 | data[end + 1])).any():
        raise FlacError("a frame's checksum does not hold")
    return Frames(samples, size, number, end + 2, kind)


@dataclass
class Decoded:
    payload: bytes
    offsets: np.ndarray  # first sample of each frame
    places: np.ndarray  # its byte in the stream
    kinds: np.ndarray


def decode(media: list[bytes]) -> list[Decoded]:
    """Payloads of FLAC streams, with frame checksums, sample counts and MD5 verified."""
    streams = [read_metadata(m) for m in media]
    base = np.cumsum([0, *map(len, media)])
    data = np.frombuffer(b"".join(media), np.uint8)
    parts: list[list[tuple[int, np.ndarray, int, int]]] = [[] for _ in media]
    done = np.zeros(len(media), np.int64)
    at = np.array([s.audio for s in streams], np.int64)

    def take(lanes: Lanes, begin: int, owner: np.ndarray, start: np.ndarray) -> None:
        frames = decode_frames(lanes, base[owner] + start - begin)
        values = ((frames.samples + 128) & 0xFF).astype(np.uint8).T
        for j, (i, n) in enumerate(zip(owner.tolist(), frames.size.tolist(), strict=True)):
            parts[i].append((int(done[i]), values[j, :n].copy(), int(start[j]), int(frames.kind[j])))
            done[i] += n
            at[i] = frames.end[j] + begin - base[i]

    seekable = [i for i, s in enumerate(streams) if s.points.size]
    if seekable:
        owner, start = np.repeat(seekable, [streams[i].points.size for i in seekable]), np.concatenate([streams[i].points for i in seekable])
        for k in range(0, owner.size, FRAMES_AT_A_TIME):
            some = slice(k, k + FRAMES_AT_A_TIME)
            begin = int(base[owner[k]] + start[k])
            last = owner[some][-1]
            end = int(base[owner[k + FRAMES_AT_A_TIME]] + start[k + FRAMES_AT_A_TIME]) if k + FRAMES_AT_A_TIME < owner.size and owner[k + FRAMES_AT_A_TIME] == last else int(base[last + 1])
            if (start[some] < 0).any() or (base[owner[some]] + start[some] >= end).any() or (base[owner[some]] + start[some] < begin).any():
                raise FlacError("a seek point is out of place")
            take(Lanes(data[begin:end]), begin, owner[some], start[some])
    if any(done[i] < s.samples for i, s in enumerate(streams)):
        lanes = Lanes(data)
        while (rest := np.array([i for i, s in enumerate(streams) if done[i] < s.samples], np.int64)).size:
            take(lanes, 0, rest, at[rest])
    out = []
    for i, s in enumerate(streams):
        payload = np.concatenate([p[1] for p in parts[i]]) if parts[i] else np.zeros(0, np.uint8)
        if payload.size != s.samples or at[i] != len(media[i]) or hashlib.md5((payload ^ 0x80).tobytes()).digest() != s.md5:
            raise FlacError("the stream's length or MD5 does not hold")
        out.append(Decoded(payload.tobytes(), np.array([p[0] for p in parts[i]]), np.array([p[2] for p in parts[i]]), np.array([p[3] for p in parts[i]])))
    return out


# --- columns ----------------------------------------------------------------------------------------------------


def _store_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in text_blocks(batch, limit=BATCH_BYTES):
            sizes = np.diff(offsets)
            padded = np.maximum(UNIT, -(-sizes // UNIT) * UNIT)
            payload = np.zeros(int(padded.sum()), np.uint8)
            for at, a, b in zip((np.cumsum(padded) - padded).tolist(), offsets.tolist(), offsets[1:].tolist()):
                payload[at : at + b - a] = data[a:b]
            yield pa.record_batch({"doc_id": batch.column("doc_id").slice(first, end - first), "n_bytes": pa.array(sizes), "media": pa.array(encode(payload, padded), pa.binary())})


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) for each row of `docs` (doc_id, text): the text's UTF-8 bytes, padded with zero bytes to a
    positive multiple of UNIT, as a FLAC stream. Null counts as empty and gives UNIT zero bytes; repeated rows each get a
    row; long texts are encoded in runs of frames; an empty table gives an empty one; other columns are ignored."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_store_rows, "doc_id long, n_bytes long, media binary")


def _groups(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Streams in groups of about BATCH_BYTES: (first row, streams)."""
    first, held, size = 0, [], 0
    for row, value in enumerate(column):
        held.append(value.as_py())
        size += len(held[-1])
        if size >= BATCH_BYTES:
            yield first, held
            first, held, size = row + 1, [], 0
    if held:
        yield first, held


_BLOCK = pa.struct([("sample_offset", pa.int64()), ("byte_offset", pa.int64()), ("kind", pa.int32()), ("pcm", pa.binary())])


def _read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, media in _groups(batch.column("media")):
            try:
                rows, errors = decode(media), [None] * len(media)
            except FlacError:
                rows, errors = [], []
                for m in media:
                    try:
                        rows += decode([m])
                        errors.append(None)
                    except FlacError as e:
                        rows.append(None)
                        errors.append(str(e))
            blocks = []
            for r in rows:
                ends = [] if r is None else [*r.offsets[1:].tolist(), len(r.payload)]
                blocks.append(None if r is None else [
                    {"sample_offset": a, "byte_offset": p, "kind": k, "pcm": r.payload[a:b]} for a, b, p, k in zip(r.offsets.tolist(), ends, r.places.tolist(), r.kinds.tolist(), strict=True)])
            yield pa.record_batch({
                "doc_id": batch.column("doc_id").slice(first, len(rows)), "n_bytes": batch.column("n_bytes").slice(first, len(rows)),
                "media_bytes": pa.array([len(m) for m in media], pa.int64()), "media_sha256": pa.array([hashlib.sha256(m).hexdigest() for m in media]),
                "blocks": pa.array(blocks, pa.list_(_BLOCK)), "error": pa.array(errors, pa.string()),
            })


def read_back(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media_bytes, media_sha256, blocks, error) of each row of a table (doc_id, n_bytes, media) whose
    media is not null: PCM blocks by frame, with the first sample of each and its byte in the stream.

    A damaged stream, or one whose checksums don't hold, has null blocks and its error; it fails no other row.
    """
    schema = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, blocks array<struct<sample_offset: bigint, byte_offset: bigint, kind: int, pcm: binary>>, error string"
    return media.select("doc_id", "n_bytes", "media").where("media is not null").mapInArrow(_read_rows, schema)


def pcm_blocks(media: DataFrame) -> DataFrame:
    """(doc_id, block, sample_offset, byte_offset, pcm) of a table (doc_id, media): unsigned 8-bit PCM by frame, so that a
    reader can seek. Damaged streams have no blocks here; read_back() names their errors."""
    read = read_back(media.select("doc_id", F.lit(None).cast("long").alias("n_bytes"), "media"))
    return read.select("doc_id", F.posexplode("blocks").alias("block", "b")).select("doc_id", "block", "b.sample_offset", "b.byte_offset", "b.pcm")


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {"payload_bytes": [], "payload_sha256": [], "tail_crc32": [], "feature": []}
        listed = batch.column("blocks")
        for row in range(batch.num_rows):
            if not listed[row].is_valid:
                for values in out.values():
                    values.append(None)
                continue
            blocks = listed[row].values
            pcm, kinds = blocks.field("pcm").to_pylist(), blocks.field("kind").to_numpy()
            whole, total, tail = hashlib.sha256(), 0, b""
            for p in pcm:
                whole.update(p)
                total += int(np.frombuffer(p, np.uint8).sum())
                tail = (tail + p)[-UNIT:]
            n = sum(map(len, pcm))
            out["payload_bytes"].append(n)
            out["payload_sha256"].append(whole.hexdigest())
            out["tail_crc32"].append(zlib.crc32(tail))
            out["feature"].append(";".join([f"frames:{kinds.size}", *(f"{name}:{int((kinds == k).sum())}" for k, name in enumerate(KIND_NAMES)), f"mean:{total / n:.3f}"]))
        yield pa.record_batch({
            "doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), "payload_bytes": pa.array(out["payload_bytes"], pa.int64()),
            "payload_sha256": pa.array(out["payload_sha256"], pa.string()), "tail_crc32": pa.array(out["tail_crc32"], pa.int64()),
            "media_bytes": batch.column("media_bytes"), "media_sha256": batch.column("media_sha256"), "feature": pa.array(out["feature"], pa.string()), "error": batch.column("error"),
        })


def digest(media: DataFrame) -> DataFrame:
    """Digests of the PCM blocks that read_back() gives of a table of `store`; null for a damaged stream, with its error."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    return read_back(media).mapInArrow(_digest_rows, schema)


def op4_flac_media(spark, sf_dir: str) -> DataFrame:
    """Stores every text of `documents` as FLAC, reads it back in PCM blocks and digests those; edge cases as in store()."""
    return digest(store(spark.read.parquet(f"{sf_dir}/documents.parquet")))
