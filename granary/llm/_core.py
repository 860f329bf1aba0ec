"""Shared parts of the training-data operators: scratch tables, Arrow batches cut by bytes, hashing over byte buffers."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import guard

U64 = np.uint64
BATCH_ROWS = 1000
_ROOTS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``); only where that is unset, as in tests, a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "granary-checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        _ROOTS[app] = f"{base.rstrip('/')}/granary-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _ROOTS[app])
    return _ROOTS[app]


def release(spark: SparkSession) -> None:
    """Delete the session's scratch tables; results that still read them are void then."""
    folder = _ROOTS.pop(spark.sparkContext.applicationId, None)
    if folder:
        _remove(spark, folder)


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session or its JVM is gone: there is nothing left to ask for the removal
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it again."""
    spark = guard(df.sparkSession)
    small_batches(spark)
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(table: DataFrame) -> None:
    """Delete a table of ``written`` that no plan reads any more."""
    path = getattr(table, "_scratch_path", None)
    if path:
        _remove(table.sparkSession, path)


def partitions_for(rows: int, per_partition: int, spark: SparkSession) -> int:
    """As many partitions as the rows need, and no fewer than the session's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(rows) // per_partition))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(guard(spark))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- memory of the workers -----------------------------------------------------------------------------------------


def lean(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function, giving freed memory back to the system at the end of its task: workers outlive tasks and stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            _TABLE.clear()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows, where the session has Spark's own number: rows here are whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


# ---- Arrow batches -------------------------------------------------------------------------------------------------


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows in them; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most max_bytes of text, or a single longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.diff(text_buffer(batch.column(batch.schema.get_field_index(text)))[1])
        ends = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


# ---- hashing -------------------------------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _TABLE.get("base")
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        for name, value in (("base", _BASE), ("inverse", _INVERSE)):
            out = np.full(size, value, U64)
            out[0] = 1
            _TABLE[name] = np.multiply.accumulate(out)
    return _TABLE["base"][:n], _TABLE["inverse"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums whose differences, brought back to position 0 by ``span_hash``, identify byte spans."""
    out = np.zeros(len(data) + 1, U64)
    if len(data):
        np.cumsum((data.astype(U64) + U64(1)) * powers(len(data))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal bytes have equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, U64)
    value = (prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts]
    return mix(value + (ends - starts).astype(U64) * U64(0xA0761D6478BD642F))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of all rows, and the first word of each row (len(offsets) values)."""
    n = len(data)
    solid = ~SPACE[data]
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    after[inner - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of each row's word shingles; a row with fewer words has its whole sequence as one."""
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    codes = span_hash(prefix_hash(data), starts, ends)
    total = len(codes)
    run = np.zeros(max(0, total - width + 1), U64)
    for i in range(width):
        run = run * U64(0xE7037ED1A0B428DB) + codes[i : total - width + 1 + i]
    run = mix(run)
    out = []
    for row in range(len(offsets) - 1):
        a, b = int(first[row]), int(first[row + 1])
        if b - a >= width:
            part = np.sort(run[a : b - width + 1])
            keep = np.empty(len(part), bool)
            keep[0] = True
            np.not_equal(part[1:], part[:-1], out=keep[1:])
            out.append(part[keep])
        elif b > a:
            value = U64(b - a)
            with np.errstate(over="ignore"):
                for code in codes[a:b]:
                    value = value * U64(0xE7037ED1A0B428DB) + code
            out.append(mix(np.array([value], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out


def set_ids(sets: list[np.ndarray]) -> np.ndarray:
    """A 128-bit name for each set (n x 2 uint64, big-endian order on write); equal sets have equal names."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.zeros((len(sets), 2), U64)
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, U64)
    full = np.flatnonzero(sizes)
    if len(full):
        at = (np.cumsum(sizes) - sizes)[full]
        out[full, 0] = mix(np.add.reduceat(mix(flat ^ U64(0x8EBC6AF09C88C6E3)), at) + sizes[full].astype(U64))
        out[full, 1] = mix(np.add.reduceat(mix(flat ^ U64(0x589965CC75374CC3)), at) ^ sizes[full].astype(U64))
    return out


def id_bytes(ids: np.ndarray) -> pa.Array:
    """16-byte binary values of n x 2 uint64 ids."""
    raw = np.ascontiguousarray(ids).astype(">u8").tobytes()
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(ids), [None, pa.py_buffer(raw)]).cast(pa.binary())


def id_values(array: pa.Array) -> np.ndarray:
    """n x 2 uint64 of a column of 16-byte binary values."""
    if not len(array):
        return np.zeros((0, 2), U64)
    raw = array.cast(pa.binary(16))
    return np.frombuffer(raw.buffers()[1], ">u8", 2 * len(raw), raw.offset * 16).reshape(-1, 2).astype(U64)


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b| for sorted distinct arrays."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int(np.count_nonzero(b[at] == a))
    return 100 * common >= percent * (len(a) + len(b) - common)
