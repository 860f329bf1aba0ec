"""Fuzzy line deduplication by MinHash.

A line is what stands between line feeds; white space at its ends and the case of A-Z don't count, and a line that is empty
then is never a copy.  Its set is its character shingles of WIDTH code points (a shorter line is one shingle).  Lines with
the same characters are one class.  Signatures of ROWS * BANDS minima are banded: classes that share a band are candidates,
their whole sets are compared exactly, pairs of Jaccard similarity >= percent / 100 are links, and distributed union-find
makes components.  Of each component the line with the smallest (doc_id, row, line number) stays; the others go.

At similarity 0.75 a pair shares a band with probability 0.998, at 0.8 with 0.9998.  A null text has no lines and stays null.
Rows of the same doc_id and text are one document and get the same text back; a null doc_id sorts first.  All columns of the
input are kept as they are, but for one named n_dropped, whose place the result's own takes.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _links
from ._core import LOWER, SPACE, U64, column, id_bytes, id_values, lean, mix, partitions_for, powers, prefix_hash, read_table, slices, text_buffer, written

WIDTH, ROWS, BANDS, PERCENT = 8, 4, 16, 75
#: Bits of the Bloom filter that names the lines to fetch; 4 MB whatever the data, a false hit only costs a row.
BLOOM_BITS = 25
#: Documents with dropped lines up to this number are broadcast with them if their lines are few too (some 10 MB); beyond it, shuffled.
BROADCAST_DOCS, BROADCAST_LINES = 200_000, 1_000_000

_RNG = np.random.default_rng(20250101)
_MULTIPLIERS = (_RNG.integers(0, 1 << 32, ROWS * BANDS, np.uint64) | U64(1)).astype(np.uint32)


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, number, start and end of every line that has more than white space, stripped."""
    feeds = np.flatnonzero(data == 10)
    starts = np.sort(np.r_[offsets[:-1], feeds + 1], kind="stable")
    # a feed's line belongs to the row that holds the feed; a row's own first line starts at its offset
    row = np.r_[np.arange(len(offsets) - 1), np.searchsorted(offsets, feeds, "right") - 1]
    order = np.argsort(np.r_[offsets[:-1], feeds + 1] * 2 + np.r_[np.ones(len(offsets) - 1, np.int64), np.zeros(len(feeds), np.int64)], kind="stable")
    starts, row = np.r_[offsets[:-1], feeds + 1][order], row[order]
    order = np.argsort(row, kind="stable")
    starts, row = starts[order], row[order]
    ends = np.r_[starts[1:] - 1, len(data)]
    last = np.r_[row[1:] != row[:-1], True]
    ends[last] = offsets[row[last] + 1]
    first = np.searchsorted(row, row, "left")
    number = np.arange(len(row)) - first
    solid = np.flatnonzero(~SPACE[data])
    if not len(solid):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    keep = b > a
    return row[keep], number[keep], solid[a[keep]], solid[b[keep] - 1] + 1


class Lines:
    """The lines of a batch: ids of all, and shingle hashes of the distinct ones."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = LOWER[data]
        self.row, self.number, start, end = line_spans(data, offsets)
        raw = data.tobytes()
        digest = b"".join(blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True))
        self.ids = np.frombuffer(digest, ">u8").reshape(-1, 2).astype(U64)
        self._bytes, self._raw, self._spans = data, raw, (start, end)

    def line(self, i: int) -> bytes:
        return self._raw[self._spans[0][i] : self._spans[1][i]]

    @cached_property
    def points(self) -> np.ndarray:
        return np.frombuffer(self._raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)

    @cached_property
    def _places(self) -> np.ndarray:
        return np.r_[0, np.cumsum((self._bytes & 0xC0) != 0x80)]

    @cached_property
    def start(self) -> np.ndarray:
        return self._places[self._spans[0]]

    @cached_property
    def end(self) -> np.ndarray:
        return self._places[self._spans[1]]

    def shingles(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return shingle_hashes(self.points, start, end)


_STEP = np.uint32(0x9E3779B1)


def _finish(x: np.ndarray) -> np.ndarray:
    """A 32-bit finaliser, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def _laid(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lines' points end to end, and each line's first place and length."""
    size = end - start
    base = np.cumsum(size) - size
    return points[np.arange(int(size.sum())) + np.repeat(start - base, size)], base, size


def shingle_hashes(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """32-bit hashes for signatures at all places of the given lines, laid end to end, and each line's first and last place."""
    points, base, size = _laid(points, start, end)
    n = len(points)
    hashes = np.zeros(n, np.uint32)
    if n >= WIDTH:
        x = points[: n - WIDTH + 1].copy()
        for j in range(1, WIDTH):
            x *= _STEP
            x += points[j : n - WIDTH + 1 + j]
        hashes[: n - WIDTH + 1] = _finish(x)
    short = np.flatnonzero(size < WIDTH)
    if len(short):
        x = size[short].astype(np.uint32)
        for j in range(WIDTH - 1):
            some = np.flatnonzero(size[short] > j)
            x[some] = x[some] * _STEP + points[base[short[some]] + j]
        hashes[base[short]] = _finish(x)
    return hashes, base, np.where(size < WIDTH, base + 1, base + size - WIDTH + 1)


def wide_hashes(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As shingle_hashes, of 64 bits for the exact check."""
    points, base, size = _laid(points, start, end)
    sums = prefix_hash(points)
    inverse = powers(len(sums))[1]
    hashes = np.zeros(len(points), U64)
    if len(points) >= WIDTH:
        hashes[: len(points) - WIDTH + 1] = mix((sums[WIDTH:] - sums[:-WIDTH]) * inverse[: len(points) - WIDTH + 1])
    short = np.flatnonzero(size < WIDTH)
    if len(short):
        first = base[short]
        hashes[first] = mix((sums[first + size[short]] - sums[first]) * inverse[first] + size[short].astype(U64))
    return hashes, base, np.where(size < WIDTH, base + 1, base + size - WIDTH + 1)


def signatures(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The minima of ROWS * BANDS multiplicative permutations over each line's places."""
    out = np.empty((len(first), ROWS * BANDS), np.uint32)
    edges = np.empty(2 * len(first), np.int64)
    edges[0::2], edges[1::2] = first, last
    if edges[-1] >= len(hashes):
        hashes = np.r_[hashes, np.zeros(1, np.uint32)]
    turned = np.empty_like(hashes)
    for j, m in enumerate(_MULTIPLIERS):
        np.multiply(hashes, m, out=turned)
        out[:, j] = np.minimum.reduceat(turned, edges)[0::2]
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for each line and band."""
    out = np.empty((len(signature), BANDS), U64)
    for b in range(BANDS):
        x = np.full(len(signature), b + 1, U64)
        for j in range(ROWS):
            x = mix(x * U64(0x9E3779B97F4A7C15) + signature[:, b * ROWS + j].astype(U64))
        out[:, b] = x
    return out


def _chunks(start: np.ndarray, end: np.ndarray, points: int = 1 << 15) -> Iterator[slice]:
    """Lines in runs of about so many code points, so that the working arrays stay in cache."""
    total = np.cumsum(end - start)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + points, "right")))
        yield slice(at, to)
        at = to


LINE = "doc_id long, row long, line int, id binary, keys binary"


def _scan_lines(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = Lines(*text_buffer(column(batch, "text")))
            at = pa.array(found.row)
            keys = np.full(len(found.ids), None, object)
            asked = np.flatnonzero(found.ids[:, 1] % U64(ASKED) == 0)
            for part in _chunks(found.start[asked], found.end[asked]) if len(asked) else ():
                some = asked[part]
                for i, own in zip(some.tolist(), band_keys(signatures(*found.shingles(found.start[some], found.end[some]))), strict=True):
                    keys[i] = own.tobytes()
            yield pa.record_batch([column(batch, "doc_id").take(at), column(batch, "row").take(at), pa.array(found.number, pa.int32()), id_bytes(found.ids), pa.array(keys, pa.binary())], names=["doc_id", "row", "line", "id", "keys"])

    return docs.mapInArrow(lean(run), LINE)


def _scan_bands(docs: DataFrame, parts: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held, ids, weight = [], [], 0
        for batch in slices(batches, "text"):
            found = Lines(*text_buffer(column(batch, "text")))
            fresh = []
            for i, name in enumerate(map(bytes, found.ids.view(np.uint8).reshape(-1, 16))):
                if name not in seen:
                    fresh.append(i)
                    if len(seen) < 1 << 19:
                        seen.add(name)
            fresh = np.array(fresh, np.int64)
            start, end = found.start[fresh], found.end[fresh]
            if len(fresh):
                held.append(band_keys(np.concatenate([signatures(*found.shingles(start[part], end[part])) for part in _chunks(start, end)])))
                ids.append(found.ids[fresh])
                weight += len(fresh)
            if weight > 1 << 16:
                yield _packed(held, ids, parts, hot)
                held, ids, weight = [], [], 0
        if weight:
            yield _packed(held, ids, parts, hot)

    return docs.select("text").mapInArrow(lean(run), _links.ENTRY)


def _packed(held: list, ids: list, parts: int, hot: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    keys, names = np.concatenate(held).ravel(), np.concatenate(ids)
    salts = None
    if len(hot[0]):
        at = np.searchsorted(hot[0], keys)
        at[at == len(hot[0])] = 0
        salts = np.where(hot[0][at] == keys, hot[1][at], 1)
    return _links.pack(keys, np.repeat(np.arange(len(names)), BANDS), names, parts, salts=salts)


#: One of so many distinct lines is asked beforehand which of its band keys are hot.
ASKED = 64


def _hot_keys(lines: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Band keys that, going by one of ASKED distinct lines, more than SPLIT lines hold, in order, and the ranges to deal them to.

    It only says how entries are dealt: a key that is missed costs a reducer memory, never a link.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = b"".join(column(batch, "keys").to_pylist())
            yield pa.record_batch([pa.array(np.frombuffer(keys, np.int64))], names=["key"])

    asked = lines.where("keys is not null").select("id", "keys").dropDuplicates(["id"])
    least = max(1, _links.SPLIT // ASKED)
    counts = asked.mapInArrow(lean(each), "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > least)
    found = sorted((row.key % (1 << 64), -(-row.n // least)) for row in counts.collect())
    return np.array([k for k, _ in found], U64), np.array([n for _, n in found], np.int64)


def _bloom_places(ids: np.ndarray) -> np.ndarray:
    ids = mix(ids + U64(0x9E3779B97F4A7C15))
    mask = U64((1 << BLOOM_BITS) - 1)
    return np.stack([ids[:, 0] & mask, (ids[:, 0] >> U64(BLOOM_BITS)) & mask, ids[:, 1] & mask, (ids[:, 1] >> U64(BLOOM_BITS)) & mask]).astype(np.int64)


def _bloom(ids: DataFrame) -> np.ndarray:
    """A filter of fixed size over a column id, joined from one of each task."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << BLOOM_BITS, bool)
        for batch in batches:
            for places in _bloom_places(id_values(batch.column(0))):
                bits[places] = True
        packed = np.packbits(bits).reshape(16, -1)
        yield pa.record_batch([pa.array(range(16), pa.int32()), pa.array([x.tobytes() for x in packed], pa.binary())], names=["part", "bits"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(blob.as_buffer(), np.uint8)
                sums[part] = sums[part] | x if part in sums else x.copy()
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "bits"])

    spec = "part int, bits binary"
    out = np.zeros((16, (1 << BLOOM_BITS) // 128), np.uint8)
    for row in ids.select("id").mapInArrow(lean(build), spec).repartition(16, "part").mapInArrow(lean(join), spec).collect():
        out[row.part] = np.frombuffer(row.bits, np.uint8)
    return out.ravel()


def _passes(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    hit = np.ones(len(ids), bool)
    for places in _bloom_places(ids):
        hit &= (bits[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1 > 0
    return hit


def _texts(docs: DataFrame, classes: DataFrame, live: DataFrame) -> DataFrame:
    """(id, text) of the classes in live, fetched by two filters of fixed size: of the documents that hold them, then of the lines."""
    wanted = written(classes.join(live.select(F.col("id").alias("num")).distinct(), "num", "left_semi").select("id", "num", "row"), "wanted")
    half = F.unhex(F.lpad(F.hex("row"), 16, "0"))
    shared = docs.sparkSession.sparkContext.broadcast((_bloom(wanted.select(F.concat(half, half).alias("id")).distinct()), _bloom(wanted)))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (of_rows, of_lines), seen = shared.value, set()
        some = (b.filter(pa.array(_passes(of_rows, np.repeat(column(b, "row").to_numpy().view(U64)[:, None], 2, 1)))) for b in batches)
        for batch in slices(some, "text"):
            found = Lines(*text_buffer(column(batch, "text")))
            fresh = []
            for i in np.flatnonzero(_passes(of_lines, found.ids)).tolist():
                if (name := found.ids[i].tobytes()) not in seen:
                    fresh.append(i)
                    if len(seen) < 1 << 19:
                        seen.add(name)
            if fresh:
                yield pa.record_batch([id_bytes(found.ids[fresh]), pa.array([found.line(i) for i in fresh], pa.binary())], names=["id", "text"])

    found = docs.select("text", "row").mapInArrow(lean(fetch), "id binary, text binary").join(wanted.select("id", "num"), "id")
    return written(found.select(F.col("num").alias("id"), "text").dropDuplicates(["id"]), "texts")


def line_sets(lines: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of normalised lines."""
    texts = [x.decode("utf-8", "replace") for x in lines]
    size = np.array([len(x) for x in texts])
    start = np.cumsum(size + 1) - size - 1
    points = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
    out = []
    for part in _chunks(start, start + size):
        hashes, first, last = wide_hashes(points, start[part], (start + size)[part])
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            s = np.sort(hashes[a:b])
            keep = s[1:] != s[:-1]
            out.append(s if keep.all() else s[np.r_[True, keep]])
    return out


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row, dropped): the numbers of the lines that go, for documents that lose any.  row: xxhash64 of the text."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.xxhash64("text"))
    lines = written(_scan_lines(docs), "lines")
    doc = F.coalesce("doc_id", F.lit(-(1 << 63)))
    place = F.struct(doc.alias("doc"), "row", "line")
    # numbers alone, which are aggregated by hash; row: a document that holds the line
    classes = lines.groupBy("id").agg(F.count("*").alias("copies"), F.min("row").alias("row"))
    classes = written(classes.withColumn("num", F.monotonically_increasing_id()), "classes")
    parts = partitions_for(classes.count() * BANDS, 1_000_000, spark)
    hot = _hot_keys(lines)
    live = _links.live_buckets(_scan_bands(docs, parts, hot), classes, parts, 0, len(hot[0]) > 0)
    comps = _links.components_of_sets(live, _texts(docs, classes, live), line_sets, PERCENT).withColumnRenamed("id", "num")
    named = classes.join(comps, "num", "left").where("copies > 1 or root is not null").select("id", F.coalesce("root", "num").alias("root"))
    # the lines that have a copy; of each component the first one stays
    copied = written(lines.select("doc_id", "row", "line", "id").join(named, "id").select("doc_id", "row", "line", "root"), "copied")
    keepers = written(copied.groupBy("root").agg(F.min(place).alias("keeper")), "keepers")
    return copied.join(keepers, "root").where(place != F.col("keeper")).groupBy("doc_id", "row").agg(F.collect_set("line").alias("dropped"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """docs with the copied lines taken out of text; adds n_dropped, the number of lines that went."""
    gone = written(dropped_lines(docs), "dropped").select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("__lines_doc"), F.col("row").alias("__lines_row"), F.col("dropped").alias("__lines_dropped"))
    docs_n, lines_n = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("__lines_dropped")), F.lit(0))).first()
    if docs_n <= BROADCAST_DOCS and lines_n <= BROADCAST_LINES:
        gone = F.broadcast(gone)
    text = F.col("text").cast("string")
    keys = {"__lines_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "__lines_row": F.xxhash64(text)}
    joined = docs.drop("n_dropped").withColumns(keys).join(gone, ["__lines_doc", "__lines_row"], "left")
    # only the texts that lose lines go through Python; a mark of text that is null is none of them
    changed = _without(F.when(F.col("__lines_dropped").isNotNull(), text), F.col("__lines_dropped"))
    out = {"text": F.when(F.col("__lines_dropped").isNotNull(), changed).otherwise(F.col("text")), "n_dropped": F.coalesce(F.size("__lines_dropped").cast("long"), F.lit(0).cast("long"))}
    out["n_dropped"] = F.when(F.col("__lines_dropped").isNotNull(), out["n_dropped"]).otherwise(F.lit(0).cast("long"))
    return joined.withColumns(out).drop("__lines_doc", "__lines_row", "__lines_dropped")


@F.pandas_udf(T.StringType())
def _without(texts: pd.Series, dropped: pd.Series) -> pd.Series:
    """Each text without the lines of the given numbers."""

    def one(text: str | None, numbers: np.ndarray | None) -> str | None:
        if text is None or numbers is None:
            return None
        gone = set(numbers.tolist())
        return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)

    return pd.Series([one(t, d) for t, d in zip(texts, dropped, strict=True)], dtype=object)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(read_table(spark, sf_dir, "documents")).select("doc_id", "n_dropped", "text")
