import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from granary.llm import flac

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("media", T.StringType()), T.StructField("n_bytes", T.StringType())])
TEXTS = ["", None, "a", "x" * 64, "x" * 65, "héllo wörld " * 400, "\x00", "long " * 60000, "".join(chr(33 + (i * i) % 90) for i in range(5000)), "x" * 64]


def test_crc_by_hand():
    data = np.frombuffer(b"123456789" * 2, np.uint8)
    assert flac.crc8(b"123456789") == 0xF4
    assert flac.crc16(data, np.array([0, 9]), np.array([9, 18])).tolist() == [0xFEE8, 0xFEE8]


def test_codec_round_trip_is_exact():
    rng = np.random.default_rng(5)
    spans = [rng.integers(0, 256, 64 * k).astype(np.uint8) for k in (1, 2, 16, 17, 33)]
    spans += [np.zeros(64, np.uint8), np.full(4096, 200, np.uint8), (128 + 100 * np.sin(np.arange(8192) / 20)).astype(np.uint8), np.where(rng.random(2048) < 0.01, 255, 0).astype(np.uint8)]
    data, offsets = np.concatenate(spans), np.r_[0, np.cumsum([len(s) for s in spans])]
    streams = flac.encode_payloads(data, offsets)
    for span, stream, samples in zip(spans, streams, flac.decode_streams(streams), strict=True):
        assert ((samples.astype(np.int8).view(np.uint8) ^ 0x80) == span).all()
        assert stream == flac.encode_payloads(span, np.array([0, len(span)]))[0]
    assert len(streams[7]) < 0.6 * 8192  # a sine is predicted
    assert (flac.seek(streams[7], 5000, 2000) == flac.decode_streams([streams[7]])[0][5000:7000]).all()


def _bits(*fields):
    return "".join(format(v & (1 << w) - 1, f"0{w}b") for v, w in fields)


def _frame(body, n, number=0, bits=8):
    head = bytes([0xFF, 0xF8, 6 << 4, (1 if bits == 8 else 4) << 1, number, n - 1])
    head += bytes([flac.crc8(head)])
    body += "0" * (-len(body) % 8)
    raw = head + int(body, 2).to_bytes(len(body) // 8, "big")
    total = flac.crc16(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))[0]
    return raw + int(total).to_bytes(2, "big")


def _rice(values, k):
    out = ""
    for v in values:
        u = 2 * v if v >= 0 else -2 * v - 1
        out += "0" * (u >> k) + "1" + (format(u & (1 << k) - 1, f"0{k}b") if k else "")
    return out


def _stream(frames, total, bits=8):
    info = (16).to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | (bits - 1) << 36 | total).to_bytes(8, "big") + bytes(16)
    return b"fLaC\x80\x00\x00\x22" + info + b"".join(frames)


def test_decoder_on_hand_made_frames():
    """Fixed order 3, two partitions, 5-bit parameters, wasted bits, long quotients and 16-bit samples, all written by hand."""
    rng = np.random.default_rng(1)
    x = np.cumsum(np.cumsum(rng.integers(-1, 2, 32)))
    rest = x[3:] - 3 * x[2:-1] + 3 * x[1:-2] - x[:-3]
    body = _bits((0, 1), (8 + 3, 6), (0, 1), *[(int(v), 16) for v in x[:3]], (1, 2), (1, 4), (2, 5)) + _rice(rest[:13].tolist(), 2) + _bits((0, 5)) + _rice(rest[13:].tolist(), 0)
    second = _bits((0, 1), (0x20, 6), (1, 1), (1, 3), (5, 13), (3, 4), (0, 5), (1, 4), (0, 2), (0, 4), (0, 4)) + _rice([40] + [0] * 30, 0)
    (got,) = flac.decode_streams([_stream([_frame(body, 32, 0, 16), _frame(second, 32, 1, 16)], 64, 16)])
    assert (got[:32] == x).all()
    want = np.r_[5, np.full(31, 45)] * 8
    assert (got[32:] == want).all()


def _texts(n, seed):
    """Texts of random characters, incompressible so that frames are verbatim."""
    rng = np.random.default_rng(seed)
    return "".join(chr(c) for c in rng.integers(0, 0x7FF, n)).encode()


def _codec(payload):
    raw = np.frombuffer(payload, np.uint8)
    stream = flac.encode_payloads(raw, np.array([0, len(raw)]))[0]
    return (flac.decode_streams([stream, stream])[1].astype(np.int8).view(np.uint8) ^ 0x80).tobytes(), stream


def test_text_that_spells_a_frame_header():
    spelt = bytes([0x7F, 0x78, 0xE1, 0x80, 0x81, 0x20, 0x00])
    for seed in range(5):
        data = _texts(2000, seed)
        at = 400
        while data[at] & 0xC0 == 0x80:
            at += 1
        data = data[:at] + spelt + data[at:]
        data.decode()
        read, stream = _codec(data)
        assert read == data
        assert len(flac.find_frames(stream)[1]) and (flac.seek(stream, 1500, 300).astype(np.int8).view(np.uint8) ^ 0x80).tobytes() == data[1500:1800]


def test_headers_spelt_everywhere():
    """Every frame number's header in verbatim data, also with the checksum that the frame would have if it ended there."""
    rng = np.random.default_rng(3)
    for trial in range(20):
        data = bytearray(rng.integers(0, 256, 1024 * 6).astype(np.uint8).tobytes())
        for number in range(1, 6):
            at = int(rng.integers(8, 5000))
            head = flac._header(number, 1024)
            data[at : at + len(head)] = bytes(x ^ 0x80 for x in head)
        _, stream = _codec(bytes(data))
        first = flac._metadata(stream)[1]
        head, place = flac._header(1, 1024), 500
        # the bytes before the feigned header are the CRC-16 of what the first frame would then be
        body = bytearray(stream[first : first + 7] + bytes(x ^ 0x80 for x in data[: place - 2]))
        total = int(flac.crc16(np.frombuffer(bytes(body), np.uint8), np.array([0]), np.array([len(body)]))[0])
        data[place - 2 : place] = bytes(x ^ 0x80 for x in total.to_bytes(2, "big"))
        data[place : place + len(head)] = bytes(x ^ 0x80 for x in head)
        assert _codec(bytes(data))[0] == bytes(data)


def test_walked_frames_are_the_found_ones():
    spans = [b"some text, twice over. " * 300, bytes(3000), _texts(3000, 9)]
    for span in spans:
        raw = np.frombuffer(span, np.uint8)
        stream = flac.encode_payloads(raw, np.array([0, len(raw)]))[0]
        info, frames = flac.find_frames(stream)
        assert list(flac.walk_frames(stream, info, frames[0][0])) == frames


def test_features_by_hand():
    def plain(x):
        x = [int(v) for v in x]
        steps = [abs(b - a) for a, b in zip(x, x[1:], strict=False)]
        cross = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))
        return f"ms={sum(v * v for v in x) / len(x):.4f};zc={cross};peak={max(abs(v) for v in x)};step={sum(steps) / len(x):.4f}"

    rng = np.random.default_rng(2)
    spans = [rng.integers(-128, 128, n).astype(np.int32) for n in (64, 128, 640)] + [np.full(64, -128, np.int32)]
    assert flac.features(spans) == [plain(s) for s in spans]


def test_broken_streams_are_refused():
    stream = bytearray(flac.encode_payloads(np.frombuffer(b"some text " * 64, np.uint8), np.array([0, 640]))[0])
    stream[-40] ^= 4
    with pytest.raises(ValueError):
        flac.decode_streams([bytes(stream)])
    with pytest.raises(ValueError):
        flac.decode_streams([b"RIFF" + bytes(60)])


def test_query_digest(spark):
    rows = [(i, t, "m", "n") for i, t in enumerate(TEXTS)] + [(None, "x" * 64, "m", "n")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = flac.digest(flac.encode(docs)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t, *_ in rows:
        data = (t or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        r = by[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert by[3].media_sha256 == by[9].media_sha256 == by[None].media_sha256 and by[3].feature == by[9].feature


def test_pcm_blocks(spark):
    docs = spark.createDataFrame([(1, "abc " * 1000, "", "")], SCHEMA)
    rows = sorted(flac.pcm_blocks(flac.encode(docs), 1500).collect(), key=lambda r: r.block)
    assert [(r.sample_offset, r.n_samples) for r in rows] == [(0, 1500), (1500, 1500), (3000, 1032)]
    whole = np.frombuffer(b"".join(r.pcm for r in rows), np.uint8) ^ 0x80
    assert whole.tobytes()[:4000] == b"abc " * 1000


def test_digest_of_many_blocks_and_repeated_rows(spark, monkeypatch):
    """Streams of several blocks, rows that repeat, and batches that end within a stream."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        text = "some words " * 30_000
        docs = spark.createDataFrame([(1, text, "", ""), (1, text, "", ""), (2, "x", "", ""), (3, text + "y", "", "")], SCHEMA).coalesce(1)
        got = flac.digest(flac.encode(docs)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for r, t in zip(got, [text, text, "x", text + "y"], strict=True):
        payload = t.encode() + bytes(-len(t) % 64 or (64 if not t else 0))
        assert (r.payload_bytes, r.payload_sha256) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert r.feature == flac.features([(np.frombuffer(payload, np.uint8) ^ 0x80).view(np.int8).astype(np.int32)])[0]


def test_empty_table(spark):
    assert flac.digest(flac.encode(spark.createDataFrame([], SCHEMA))).collect() == []
