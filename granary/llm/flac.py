"""Lossless media columns: FLAC streams written and read with numpy, many frames at a time.

``encode_payloads`` stores byte payloads as mono FLAC with 8-bit samples (byte ^ 0x80, so that the samples are signed):
frames of BLOCK samples, each with the cheapest of a constant, a verbatim, a fixed (order 0 to 2) and a quantised linear
predictor of order 2, residuals Rice-coded, and a seek table.  ``decode_streams`` reads mono streams of 8 or 16 bits back:
frames are found by their sync code, header checksum and running number; header CRC-8 and frame CRC-16 are verified; Rice
residuals are decoded step by step for all frames of a group at once; predictors are undone likewise.  Data may spell a frame
header: where a checksum or the digest of the samples then doesn't fit, the frames of that stream are walked by their coded
lengths, which no data can feign.  ``pcm_blocks`` gives the decoded samples as rows with seekable sample offsets; the digest
reads these.

Null or empty text is a payload of 64 zero bytes.  Equal payloads give equal streams, whatever else is in the batch.  A row of
any length is handled in groups of FRAMES frames, so memory doesn't follow the length of a text beyond a few copies of it.
Broken checksums, stereo and escaped partitions raise ValueError.  Null doc_ids stay; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._core import column, lean, read_table, slices, text_buffer

BLOCK = 1024
FRAMES = 4096
RATE = 8000
SEEK_EVERY = 16
PRECISION, SHIFT = 12, 10
#: Fixed predictors as coefficients of earlier samples, by order.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


# ---- checksums -----------------------------------------------------------------------------------------------------


@lru_cache(None)
def _crc_table(polynomial: int, bits: int) -> np.ndarray:
    out = np.zeros(256, np.int64)
    for byte in range(256):
        x = byte << (bits - 8)
        for _ in range(8):
            x = ((x << 1) ^ (polynomial if x >> (bits - 1) else 0)) & ((1 << bits) - 1)
        out[byte] = x
    return out


@lru_cache(None)
def _crc8_list() -> list[int]:
    return _crc_table(0x07, 8).tolist()


def crc8(data: bytes) -> int:
    table, x = _crc8_list(), 0
    for byte in data:
        x = table[x ^ byte]
    return x


_FAR: list[np.ndarray] = []


def _crc16_far(length: int) -> np.ndarray:
    """Row d: what each byte contributes to a CRC-16 when d bytes follow it."""
    if not _FAR or len(_FAR[0]) < length:
        size = 1 << max(11, int(length - 1).bit_length())
        near = _crc_table(0x8005, 16)
        out = np.empty((size, 256), np.uint16)
        row = near
        for d in range(size):
            out[d] = row
            row = ((row << 8) & 0xFFFF) ^ near[row >> 8]
        _FAR[:] = [out]
    return _FAR[0]


def crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of many byte spans that follow each other in data, by linearity."""
    lengths = ends - starts
    far = _crc16_far(int(lengths.max()))
    back = np.repeat(ends, lengths) - 1
    at = np.arange(len(back)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)
    return np.bitwise_xor.reduceat(far.ravel()[(back - at) * 256 + data[at]], np.cumsum(lengths) - lengths)


# ---- encoder -------------------------------------------------------------------------------------------------------


def _number(n: int) -> bytes:
    """A frame number in the format's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    tail = []
    first = 0x3F
    while n > first:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        first >>= 1
    return bytes([0xFF ^ (first << 1 | 1) | n, *tail[::-1]])


@lru_cache(1 << 16)
def _header(number: int, length: int) -> bytes:
    code = {256: 8, 512: 9, 1024: 10, 2048: 11, 4096: 12}.get(length, 6 if length <= 256 else 7)
    size = b"" if code > 7 else (length - 1).to_bytes(code - 5, "big")
    head = bytes([0xFF, 0xF8, code << 4, 0 << 4 | 1 << 1]) + _number(number) + size
    return head + bytes([crc8(head)])


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
    for j in range(width):
        bits[at + j] = (value >> (width - 1 - j)) & 1


def _encode_group(samples: np.ndarray, starts: np.ndarray, lengths: np.ndarray, numbers: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Frames of the given spans of samples, and the offsets of the frames in them."""
    f, top = len(starts), int(lengths.max())
    at = np.minimum(starts[:, None] + np.arange(top), len(samples) - 1)
    inside = np.arange(top) < lengths[:, None]
    x = np.where(inside, samples[at], 0).astype(np.int32)
    one, two = np.zeros_like(x), np.zeros_like(x)
    one[:, 1:], two[:, 2:] = x[:, :-1], x[:, :-2]
    r0, r1, r2 = ((x * y).sum(1, dtype=np.int64).astype(np.float64) for y in (x, one, two))
    det = r0 * r0 - r1 * r1
    det[det <= 0] = np.inf
    limit = 1 << (PRECISION - 1)
    c1 = np.clip(np.rint((r1 * r0 - r1 * r2) / det * (1 << SHIFT)), -limit, limit - 1).astype(np.int32)
    c2 = np.clip(np.rint((r0 * r2 - r1 * r1) / det * (1 << SHIFT)), -limit, limit - 1).astype(np.int32)
    best, kind, chosen = None, np.zeros(f, np.int64), None
    for name, guess in enumerate((None, one, 2 * one - two, (c1[:, None] * one + c2[:, None] * two) >> SHIFT)):
        rest = x if guess is None else x - guess
        code = (rest << 1) ^ (rest >> 31)
        code[~inside] = 0
        code[:, : min(name, 2)] = 0
        cost = code.sum(1, dtype=np.int64)
        if best is None:
            best, chosen = cost, code
        else:
            better = cost < best
            best[better], chosen[better], kind[better] = cost[better], code[better], name
    order = np.minimum(kind, 2)
    count = lengths - order
    totals = np.stack([(chosen >> k).sum(1, dtype=np.int64) + count * (k + 1) for k in range(9)])
    rice = totals.argmin(0)
    body = totals.min(0)
    same = (np.where(inside, x, x[:, :1]) == x[:, :1]).all(1)
    head = 8 + 8 * order + np.where(kind == 3, 9 + 2 * PRECISION, 0) + 10
    form = np.where(same, 0, np.where(head + body >= 8 + 8 * lengths, 1, 2))  # constant, verbatim, predicted
    payload = np.where(form == 0, 16, np.where(form == 1, 8 + 8 * lengths, head + body))
    heads = [_header(int(n), int(m)) for n, m in zip(numbers, lengths, strict=True)]
    size = np.array([len(h) for h in heads]) + (payload + 7) // 8 + 2
    offset = np.r_[0, np.cumsum(size)]
    bits = np.zeros(int(offset[-1]) * 8, np.uint8)
    sub = 8 * (offset[:-1] + [len(h) for h in heads])
    _put(bits, sub, np.where(form == 0, 0, np.where(form == 1, 2, np.where(kind == 3, 0x20 + order - 1, 8 + order) << 1)), 8)
    flat = np.flatnonzero(form == 0)
    _put(bits, sub[flat] + 8, x[flat, 0] & 255, 8)
    for i in np.flatnonzero(form == 1):
        bits[sub[i] + 8 : sub[i] + 8 + 8 * lengths[i]] = np.unpackbits((x[i, : lengths[i]] & 255).astype(np.uint8))
    coded = form == 2
    for j in range(2):
        some = np.flatnonzero(coded & (order > j))
        _put(bits, sub[some] + 8 + 8 * j, x[some, j] & 255, 8)
    some = np.flatnonzero(coded & (kind == 3))
    at = sub[some] + 24
    _put(bits, at, np.full(len(some), PRECISION - 1), 4)
    _put(bits, at + 4, np.full(len(some), SHIFT), 5)
    _put(bits, at + 9, c1[some] & ((1 << PRECISION) - 1), PRECISION)
    _put(bits, at + 9 + PRECISION, c2[some] & ((1 << PRECISION) - 1), PRECISION)
    some = np.flatnonzero(coded)
    _put(bits, (sub + head - 4)[some], rice[some], 4)
    mask = inside & coded[:, None] & (np.arange(top) >= order[:, None])
    code = chosen[mask]
    if len(code):
        k = np.broadcast_to(rice[:, None], mask.shape)[mask]
        quotient = code >> k
        width = quotient + 1 + k
        ends = np.cumsum(width)
        first = np.cumsum(count[some]) - count[some]
        base = (sub + head)[some] - (ends[first] - width[first])
        place = ends - width + quotient + np.repeat(base, count[some])
        bits[place] = 1
        for j in range(int(k.max(initial=0))):
            deep = np.flatnonzero(k > j)
            bits[place[deep] + 1 + j] = (code[deep] >> (k[deep] - 1 - j)) & 1
    out = np.packbits(bits)
    for o, h in zip(offset[:-1], heads, strict=True):
        out[o : o + len(h)] = np.frombuffer(h, np.uint8)
    sums = crc16(out, offset[:-1], offset[1:] - 2)
    out[offset[1:] - 2], out[offset[1:] - 1] = sums >> 8, sums & 255
    return out.tobytes(), offset


def encode_payloads(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A FLAC stream for each span of bytes; no span may be empty."""
    sizes = np.diff(offsets)
    per = -(-sizes // BLOCK)
    doc = np.repeat(np.arange(len(sizes)), per)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    starts = offsets[:-1][doc] + number * BLOCK
    lengths = np.minimum(BLOCK, offsets[1:][doc] - starts)
    samples = (data ^ 0x80).view(np.int8)
    frames: list[bytes] = []
    for a in range(0, len(doc), FRAMES):
        blob, at = _encode_group(samples, starts[a : a + FRAMES], lengths[a : a + FRAMES], number[a : a + FRAMES])
        frames += [blob[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
    out, first = [], 0
    for i, n in enumerate(per):
        own = frames[first : first + n]
        first += n
        places = np.cumsum([0] + [len(x) for x in own])
        total = int(sizes[i])
        info = min(BLOCK, max(16, total)).to_bytes(2, "big") * 2 + min(map(len, own)).to_bytes(3, "big") + max(map(len, own)).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | total).to_bytes(8, "big") + hashlib.md5(samples[offsets[i] : offsets[i + 1]].tobytes()).digest()
        points = b"".join((j * BLOCK).to_bytes(8, "big") + int(places[j]).to_bytes(8, "big") + min(BLOCK, total - j * BLOCK).to_bytes(2, "big") for j in range(0, n, SEEK_EVERY))
        out.append(b"fLaC\x00\x00\x00\x22" + info + b"\x83" + len(points).to_bytes(3, "big") + points + b"".join(own))
    return out


# ---- decoder -------------------------------------------------------------------------------------------------------

#: Leading zeros of 16 bits.
LEADING = 16 - np.ceil(np.log2(np.arange(1 << 16) + 1.0)).astype(np.uint8)


def _metadata(stream: bytes) -> tuple[dict, int]:
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, info, last = 4, {"seek": []}, False
    while not last:
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            info |= {"block": int.from_bytes(body[2:4], "big"), "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "total": packed & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            info["seek"] = [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big"), int.from_bytes(body[i + 16 : i + 18], "big")) for i in range(0, size, 18)]
        at += 4 + size
    if info.get("channels") != 1 or info["bits"] not in (8, 16):
        raise ValueError("only mono streams of 8 or 16 bits are read")
    return info, at


def _frame_header(data: bytes, at: int) -> tuple[int, int, int] | None:
    """(number, samples, bytes of the header) if a frame header with a right checksum stands here."""
    code, rate = data[at + 2] >> 4, data[at + 2] & 15
    lead = data[at + 4]
    more = 0 if lead < 0x80 else 8 - int(lead ^ 0xFF).bit_length() - 1
    number = lead if not more else lead & (0x3F >> more)
    for byte in data[at + 5 : at + 5 + more]:
        number = number << 6 | byte & 0x3F
    end = at + 5 + more
    if code == 6 or code == 7:
        size = int.from_bytes(data[end : end + code - 5], "big") + 1
        end += code - 5
    elif code == 1:
        size = 192
    elif 2 <= code <= 5:
        size = 576 << (code - 2)
    elif code >= 8:
        size = 256 << (code - 8)
    else:
        return None
    end += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if end >= len(data) or data[at + 3] >> 4 or crc8(data[at:end]) != data[end]:
        return None
    return number, size, end + 1 - at


def find_frames(stream: bytes) -> tuple[dict, list[tuple[int, int, int, int]]]:
    """Stream info, and for each frame (offset, bytes, samples, bytes of its header)."""
    info, first = _metadata(stream)
    raw = np.frombuffer(stream, np.uint8)
    sync = np.flatnonzero((raw[first:-1] == 0xFF) & (raw[first + 1 :] & 0xFE == 0xF8)) + first
    found: list[tuple[int, int, int]] = []
    for at in sync.tolist():
        if at + 6 > len(stream) or (got := _frame_header(stream, at)) is None:
            continue
        if got[0] == (len(found) if not stream[at + 1] & 1 else sum(x[1] for x in found)):
            found.append((at, got[1], got[2]))
    if not found or found[0][0] != first:
        raise ValueError("no frame where the first is due")
    ends = [x[0] for x in found[1:]] + [len(stream)]
    return info, [(at, end - at, n, head) for (at, n, head), end in zip(found, ends, strict=True)]


def walk_frames(stream: bytes, info: dict, at: int, enough: int | None = None) -> Iterator[tuple[int, int, int, int]]:
    """(offset, bytes, samples, bytes of its header) of the frames from a place on, by their coded lengths, until enough samples."""
    got = 0
    while at < len(stream) and (enough is None or got < enough):
        if at + 6 > len(stream) or stream[at] != 0xFF or stream[at + 1] & 0xFE != 0xF8 or (header := _frame_header(stream, at)) is None:
            raise ValueError("no frame where one is due")
        _, n, head = header
        end = (_subframe_end(stream, at + head, n, info["bits"]) + 7 >> 3) + 2
        if end > len(stream):
            raise ValueError("a frame is cut off")
        yield at, end - at, n, head
        at, got = end, got + n


def _subframe_end(stream: bytes, at: int, n: int, bits: int) -> int:
    """The bit after a mono frame's subframe."""
    b = _Bits(stream, 8 * at)
    kind = b.take(8)
    if kind & 1:
        bits -= 1
        while not b.take(1):
            bits -= 1
    kind = kind >> 1 & 0x3F
    if kind < 2:
        return b.at + (n if kind else 1) * bits
    if not (8 <= kind <= 12 or kind >= 32):
        raise ValueError("unknown subframe")
    order = kind - 8 if kind < 32 else kind - 31
    b.at += order * bits
    if kind >= 32:
        precision = b.take(4) + 1
        b.at += 5 + order * precision
    method, parts = b.take(2), b.take(4)
    if method > 1:
        raise ValueError("unknown residual method")
    base = b.at & ~7
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(stream, np.uint8, min(len(stream) - (base >> 3), 8 * n + 64), base >> 3))).tolist()
    for part in range(1 << parts):
        k = b.take(4 + method)
        if k == (1 << 4 + method) - 1:
            raise ValueError("escaped partitions are not read")
        for _ in range((n >> parts) - (order if not part else 0)):
            i = bisect_left(ones, b.at - base)
            if i == len(ones):
                raise ValueError("a frame is cut off")
            b.at = base + ones[i] + 1 + k
    return b.at


class _Bits:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at

    def take(self, n: int) -> int:
        a, b = self.at >> 3, (self.at + n + 7) >> 3
        x = int.from_bytes(self.data[a:b], "big") >> (8 * b - self.at - n) & ((1 << n) - 1)
        self.at += n
        return x

    def signed(self, n: int) -> int:
        x = self.take(n)
        return x - (1 << n) if x >> (n - 1) else x


def _decode_group(data: bytes, frames: list[tuple[int, int, int, int]], bits: int) -> list[np.ndarray]:
    """Samples of each frame; (offset, bytes, samples, header bytes) are places in data."""
    raw = np.frombuffer(data, np.uint8)
    out: list[np.ndarray | None] = [None] * len(frames)
    coded = []
    for i, (at, _, n, head) in enumerate(frames):
        b = _Bits(data, 8 * (at + head))
        kind = b.take(8)
        wasted = 0
        if kind & 1:
            wasted = 1
            while not b.take(1):
                wasted += 1
        kind = kind >> 1 & 0x3F
        width = bits - wasted
        if kind == 0:
            out[i] = np.full(n, b.signed(width) << wasted, np.int32)
        elif kind == 1:
            if width != 8 or b.at % 8:
                out[i] = np.array([b.signed(width) for _ in range(n)], np.int32) << wasted
            else:
                out[i] = raw[b.at >> 3 : (b.at >> 3) + n].view(np.int8).astype(np.int32) << wasted
        elif 8 <= kind <= 12 or kind >= 32:
            order = kind - 8 if kind < 32 else kind - 31
            warm = [b.signed(width) for _ in range(order)]
            if kind < 32:
                taps, shift = FIXED[order], 0
            else:
                precision, shift = b.take(4) + 1, b.signed(5)
                taps = tuple(b.signed(precision) for _ in range(order))
            method, parts = b.take(2), b.take(4)
            if method > 1:
                raise ValueError("unknown residual method")
            coded.append((n, i, order, warm, taps, shift, 4 + method, n >> parts, b.at, wasted))
        else:
            raise ValueError("unknown subframe")
    if coded:
        coded.sort(key=lambda c: -c[0])
        for (_, i, *_, wasted), samples in zip(coded, _predicted(raw, coded), strict=True):
            out[i] = samples << wasted
    return out


def _predicted(raw: np.ndarray, coded: list[tuple]) -> Iterator[np.ndarray]:
    """Samples of frames with Rice-coded residuals, longest first; all frames take one step at a time."""
    n, order, field, part, pos = (np.array([c[j] for c in coded], np.int64) for j in (0, 2, 6, 7, 8))
    f, top = len(coded), int(n[0])
    wide = np.r_[raw, np.zeros(8, np.uint8)].astype(np.uint32)
    words = wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]
    # a field of 4 or 5 bits names the Rice parameter of each partition
    quotients, place, rices = np.zeros((top, f), np.int32), np.zeros((top, f), np.int64), np.zeros((top, f), np.uint8)
    k = np.zeros(f, np.int64)
    active = np.searchsorted(-n, -np.arange(top), "left")
    plain = bool((part == n).all() and (order == order[0]).all())
    low = int(order.min())
    for t in range(low, top):
        m = int(active[t])
        if not plain or t == low:
            due = np.flatnonzero((t >= order[:m]) & ((t == order[:m]) | (t % part[:m] == 0)))
            if len(due):
                p = pos[due]
                k[due] = (words[p >> 3] << (p & 7).astype(np.uint32)) >> (32 - field[due]).astype(np.uint32)
                if (k[due] == (1 << field[due]) - 1).any():
                    raise ValueError("escaped partitions are not read")
                pos[due] += field[due]
        p = pos[:m]
        q = LEADING[(words[p >> 3] << (p & 7).astype(np.uint32)) >> np.uint32(16)].astype(np.int64)
        if q.max() == 16:
            long = np.flatnonzero(q == 16)
            while len(long):
                at = p[long] + q[long]
                more = LEADING[(words[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(16)]
                q[long] += more
                long = long[more == 16]
        if not plain:
            idle = t < order[:m]
            q[idle] = 0
            after = np.where(idle, p, p + q + 1 + k[:m])
        else:
            after = p + q + 1 + k[:m]
        quotients[t, :m], rices[t, :m] = q, k[:m]
        place[t, :m] = p + q + 1
        pos[:m] = after
    wide = rices.astype(np.uint32)
    rest = (words[place >> 3] << (place & 7).astype(np.uint32)).astype(np.uint64) >> (np.uint64(32) - wide.astype(np.uint64))
    code = (quotients.astype(np.int64) << rices) | rest.astype(np.int64)
    x = ((code >> 1) ^ -(code & 1)).astype(np.int32)
    del quotients, place, rices, rest, code, wide
    shift = np.array([c[5] for c in coded], np.int32)
    most = int(order.max())
    taps = np.zeros((max(1, most), f), np.int32)
    for j, c in enumerate(coded):
        taps[: c[2], j] = c[4]
        x[: c[2], j] = c[3]
    used = [j for j in range(most) if taps[j].any()]
    ready = int(order.max()) if (order == order[0]).all() else 0
    for t in range(ready or low, top):
        m = int(active[t])
        guess = np.zeros(m, np.int64)
        for j in used:
            if t > j:
                guess += taps[j, :m].astype(np.int64) * x[t - 1 - j, :m]
        guess >>= shift[:m]
        if not ready:
            guess[t < order[:m]] = 0
        x[t, :m] += guess.astype(np.int32)
    x = np.ascontiguousarray(x.T)
    for j in range(f):
        yield x[j, : n[j]]


def _fitting(data: bytes, frames: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Which of the frames have the CRC-16 that they end with."""
    raw = np.frombuffer(data, np.uint8)
    starts, ends = np.array([x[0] for x in frames]), np.array([x[0] + x[1] for x in frames])
    return crc16(raw, starts, ends - 2) == raw[ends - 2].astype(np.int64) << 8 | raw[ends - 1]


def _whole(info: dict, parts: list[np.ndarray]) -> np.ndarray | None:
    """The samples, if their number and digest are those that the stream names."""
    samples = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    if info["total"] and len(samples) != info["total"]:
        return None
    if any(info["md5"]) and hashlib.md5(samples.astype(np.int8 if info["bits"] == 8 else "<i2").tobytes()).digest() != info["md5"]:
        return None
    return samples


def _decode_walked(stream: bytes) -> np.ndarray:
    """The samples of a stream whose frames are walked by their lengths."""
    info, first = _metadata(stream)
    frames = list(walk_frames(stream, info, first))
    parts = []
    for a in range(0, len(frames), FRAMES):
        some = frames[a : a + FRAMES]
        if not _fitting(stream, some).all():
            raise ValueError("a frame's CRC-16 doesn't fit")
        parts += _decode_group(stream, some, info["bits"])
    samples = _whole(info, parts)
    if samples is None:
        raise ValueError("the samples' number or MD5 doesn't fit")
    return samples


def decode_streams(streams: list[bytes]) -> list[np.ndarray]:
    """Samples (int32) of each stream, all checksums verified."""
    found: list[tuple[dict, list] | None] = []
    for s in streams:
        try:
            found.append(find_frames(s))
        except ValueError:
            found.append(None)
    kinds = {got[0]["bits"] for got in found if got}
    if len(kinds) > 1:
        return [decode_streams([s])[0] for s in streams]
    pieces: list[list[np.ndarray]] = [[] for _ in streams]
    walked = {i for i, got in enumerate(found) if got is None}
    held: list[tuple[int, tuple[int, int, int, int]]] = []
    chunks, size = [], 0

    def flush() -> None:
        nonlocal held, chunks, size
        if held:
            data = b"".join(chunks)
            walked.update(i for (i, _), fits in zip(held, _fitting(data, [x for _, x in held]), strict=True) if not fits)
            held = [x for x in held if x[0] not in walked]
            try:
                for (i, _), samples in zip(held, _decode_group(data, [x for _, x in held], next(iter(kinds))), strict=True):
                    pieces[i].append(samples)
            except (ValueError, IndexError):  # a feigned frame with a fitting checksum, or a broken stream
                walked.update(i for i, _ in held)
        held, chunks, size = [], [], 0

    for i, got in enumerate(found):
        for at, length, n, head in got[1] if got else ():
            held.append((i, (size, length, n, head)))
            chunks.append(streams[i][at : at + length])
            size += length
            if len(held) >= FRAMES:
                flush()
    flush()
    out = []
    for i, (stream, got) in enumerate(zip(streams, found, strict=True)):
        samples = None if i in walked else _whole(got[0], pieces[i])
        out.append(_decode_walked(stream) if samples is None else samples)
    return out


def seek(stream: bytes, sample: int, count: int) -> np.ndarray:
    """Samples from a position on, decoded from the last seek point before it; nothing else of the stream is read."""
    info, first = _metadata(stream)
    skip, at, _ = max((p for p in info["seek"] if p[0] <= sample), default=(0, 0, 0))
    frames = list(walk_frames(stream, info, first + at, sample + count - skip))
    if not _fitting(stream, frames).all():
        raise ValueError("a frame's CRC-16 doesn't fit")
    samples = np.concatenate(_decode_group(stream, frames, info["bits"]))
    return samples[sample - skip : sample - skip + count]


# ---- columns -------------------------------------------------------------------------------------------------------


def payloads(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows padded by zero bytes to a positive multiple of 64."""
    sizes = np.diff(offsets)
    padded = np.maximum(64, (sizes + 63) // 64 * 64)
    ends = np.cumsum(padded)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    at = np.arange(len(data)) + np.repeat(ends - padded - offsets[:-1], sizes)
    out[at] = data
    return out, np.r_[0, ends]


def encode(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a FLAC stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = text_buffer(column(batch, "text"))
            yield pa.record_batch([column(batch, "doc_id").cast(pa.int64()), pa.array(np.diff(offsets)), pa.array(encode_payloads(*payloads(data, offsets)), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, n_bytes long, media binary")


def _groups(batches: Iterator[pa.RecordBatch], limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in column(batch, "media")])
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def pcm_blocks(media: DataFrame, block: int = 1 << 16, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep..., block, sample_offset, n_samples, pcm): the decoded samples of (doc_id, media) in blocks of signed bytes.

    A stream's blocks follow each other in order, so what reads them without a shuffle meets them as one stream.
    """
    kept = [f for f in media.schema.fields if f.name in keep]
    spec = T.StructType([T.StructField("doc_id", T.LongType()), *kept, *T._parse_datatype_string("block int, sample_offset long, n_samples long, pcm binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches):
            row, at, parts = [], [], []
            for i, samples in enumerate(decode_streams(column(batch, "media").to_pylist())):
                for start in range(0, len(samples), block):
                    row.append(i)
                    at.append(start)
                    parts.append(samples[start : start + block].astype(np.int8).tobytes())
            own = [column(batch, name).take(pa.array(row, pa.int64())) for name in ("doc_id", *(f.name for f in kept))]
            numbers = [pa.array([x // block for x in at], pa.int32()), pa.array(at, pa.int64()), pa.array([len(x) for x in parts], pa.int64())]
            yield pa.record_batch([*own, *numbers, pa.array(parts, pa.binary())], names=spec.names)

    return media.select("doc_id", *(f.name for f in kept), "media").where("media is not null").mapInArrow(lean(run), spec)


def features(samples: list[np.ndarray]) -> list[str]:
    """Of the decoded samples: mean square, zero crossings, peak and mean step."""
    sizes = np.array([len(s) for s in samples])
    flat = np.concatenate(samples).astype(np.int32)
    first = np.cumsum(sizes) - sizes
    power = np.add.reduceat(flat.astype(np.int64) ** 2, first)
    peak = np.maximum.reduceat(np.abs(flat), first)
    step = np.abs(np.diff(flat, prepend=flat[:1]))
    cross = np.zeros(len(flat), np.int64)
    cross[1:] = (flat[1:] < 0) != (flat[:-1] < 0)
    step[first], cross[first] = 0, 0
    return [f"ms={p / n:.4f};zc={c};peak={m};step={s / n:.4f}" for p, c, m, s, n in zip(power.tolist(), np.add.reduceat(cross, first).tolist(), peak.tolist(), np.add.reduceat(step, first).tolist(), sizes.tolist(), strict=True)]


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(media: DataFrame) -> DataFrame:
    """What the stored streams hold, from the blocks of samples that they are decoded to."""
    names = [x.split()[0] for x in DIGEST.split(", ")]
    carried = ("doc_id", "n_bytes", "media_bytes", "media_sha256")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[tuple, list[np.ndarray]]] = []  # rows and their blocks; the last one may go on

        def done(rows: list) -> pa.RecordBatch:
            samples = [parts[0] if len(parts) == 1 else np.concatenate(parts) for _, parts in rows]
            read = [(x.view(np.uint8) ^ 0x80).tobytes() for x in samples]
            doc, n, size, digest = zip(*(own for own, _ in rows), strict=True)
            columns = [pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array([len(x) for x in read], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in read]), pa.array([zlib.crc32(x[-64:]) for x in read], pa.int64())]
            return pa.record_batch([*columns, pa.array(size, pa.int64()), pa.array(digest), pa.array(features(samples))], names=names)

        for batch in batches:
            own = zip(*(column(batch, c).to_pylist() for c in carried), strict=True)
            for row, number, pcm in zip(own, column(batch, "block").to_pylist(), column(batch, "pcm"), strict=True):
                if not number:
                    held.append((row, []))
                held[-1][1].append(np.frombuffer(pcm.as_buffer(), np.int8))
            if len(held) > 1:
                yield done(held[:-1])
                held = held[-1:]
        if held:
            yield done(held)

    stored = media.withColumns({"media_bytes": F.length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    return pcm_blocks(stored, keep=carried[1:]).mapInArrow(lean(run), DIGEST)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(encode(read_table(spark, sf_dir, "documents")))
