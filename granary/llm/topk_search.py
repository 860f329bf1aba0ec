"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has a bit for each dimension (set where the value is not negative), 64 at most.  Codes are cut into segments of
about log2(number of codes) bits, and an index has a table for each segment, from its value to the codes that have it.  The
search radius grows round by round: at radius a all buckets whose value is at Hamming distance a from the query's are looked up,
in every segment, and the codes found there for the first time are verified whole.  After that every code at a distance below
segments * (a + 1) has been seen (one of its segments must be that close), so a query is closed as soon as its k-th verified
distance is covered.  At the last radius, the width of a segment, all buckets have been looked up; there is no other way out.

The index is distributed: a block holds the codes of one segment whose values share their high bits, about CODES of them; a
block of one hot value is split by a hash of its codes.  In each round a query that is still open goes only to the blocks whose
high bits are within the radius, with its k-th distance so far, which bounds what comes back: at most k + 1 codes for each query
and block.  No block is compared with all queries, and no query with all blocks.

Rows with the same code are one entry with its k + 1 smallest ids, so a code that a third of all rows share costs no more than
another one.  A query is not its own neighbour.  Rows without a vector or an id are no queries and no neighbours; null values in
a vector count as negative; missing dimensions are clear bits; more than 64 raise.  Repeated rows of one id and code are one; an
id with several codes is a query with each of them and has their merged neighbours.  Extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._core import U64, column, lean, partitions_for, read_table, written

WIDTH, K = 64, 10
#: Codes of a block, and queries that are looked up in it together.
CODES, QUERIES = 1 << 16, 1 << 10
#: Rows of a block travel in pieces of so many codes, so that a batch of them stays small.
PIECE = 1 << 13
#: Blocks up to this number are broadcast to route queries (some 20 bytes each); beyond it the join is shuffled.
BROADCAST_BLOCKS = 500_000
#: Distance of a query that has fewer than k + 1 codes so far.
FAR = WIDTH + 1


@lru_cache(None)
def _masks(width: int, weight: int) -> np.ndarray:
    every = np.arange(1 << width)
    return every[np.bitwise_count(every) == weight]


def segments(n: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the segments for n codes: about log2(n) bits each, 8 to 22."""
    parts = min(8, max(3, round(WIDTH / max(1.0, log2(max(2, n))))))
    cuts = [WIDTH * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


class CodeTable:
    """The table of one segment over a block's codes."""

    def __init__(self, codes: np.ndarray, cuts: list[tuple[int, int]], segment: int):
        self.cuts, self.segment = cuts, segment
        value = self._value(codes, segment)
        order = np.argsort(value, kind="stable")
        self.codes, self.order = codes[order], order
        self.values, first = np.unique(value[order], return_index=True)
        self.bounds = np.r_[first, len(codes)]

    def _value(self, codes: np.ndarray, segment: int) -> np.ndarray:
        at, width = self.cuts[segment]
        return ((codes >> U64(at)) & U64((1 << width) - 1)).astype(np.int64)

    def _buckets(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, bucket) of all buckets at exactly this distance: the values are spelt out, or the table's values measured if these are fewer."""
        own, masks = self._value(queries, self.segment), _masks(self.cuts[self.segment][1], radius)
        spelt = len(masks) <= len(self.values)
        for some in np.array_split(np.arange(len(queries)), -(-len(queries) * min(len(masks), len(self.values)) // (1 << 20)) or 1):
            if spelt:
                probe = own[some][:, None] ^ masks
                at = np.searchsorted(self.values, probe)
                at[at == len(self.values)] = 0
                q, m = np.nonzero(self.values[at] == probe)
                yield some[q], at[q, m]
            else:
                q, bucket = np.nonzero(np.bitwise_count(own[some][:, None] ^ self.values) == radius)
                yield some[q], bucket

    def found(self, queries: np.ndarray, radius: int, bound: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """(query, position, distance) of codes that no smaller radius or earlier segment has met, at most bound away; and how many were verified."""
        for q, bucket in self._buckets(queries, radius):
            count = self.bounds[bucket + 1] - self.bounds[bucket]
            total = np.r_[0, np.cumsum(count)]
            start = 0
            while start < len(q):  # pieces of a bounded number of codes, or a single bucket
                stop = max(start + 1, int(np.searchsorted(total, total[start] + (1 << 20), "right")) - 1)
                part = slice(start, stop)
                who = np.repeat(q[part], count[part])
                at = np.arange(int(total[stop] - total[start])) + np.repeat(self.bounds[bucket[part]] - total[part] + total[start], count[part])
                other = queries[who] ^ self.codes[at]
                fresh = np.ones(len(at), bool)
                for j in range(len(self.cuts)):
                    if j != self.segment:
                        apart = np.bitwise_count(self._value(other, j))
                        fresh &= apart >= radius if j > self.segment else apart > radius
                who, at, other = who[fresh], at[fresh], other[fresh]
                distance = np.bitwise_count(other).astype(np.int64)
                near = distance <= bound[who]
                yield who[near], self.order[at[near]], distance[near], len(at)
                start = stop


def nearest(who: np.ndarray, distance: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k rows of each query that are first by (distance, first)."""
    order = np.lexsort((first, distance, who))
    who = who[order]
    return order[np.arange(len(who)) - np.searchsorted(who, who, "left") < k]


def code(vector: str = "embedding") -> F.Column:
    """The 64-bit code of a column of arrays; null for a null array."""
    powers = F.array(*[F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(64)])
    bits = F.zip_with(F.col(vector), powers, lambda x, p: F.when(F.coalesce(x >= 0, F.lit(False)), p).otherwise(F.lit(0).cast("long")))
    checked = F.when(F.size(vector) > 64, F.raise_error(F.lit("a code has at most 64 bits"))).otherwise(F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))
    return F.when(F.col(vector).isNotNull(), checked)


def _segment(code: str, cut: tuple[int, int], high: int) -> F.Column:
    """The high bits of a segment of a column of codes."""
    at, width = cut
    value = F.shiftrightunsigned(code, at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    return F.shiftrightunsigned(value, width - min(high, width)).cast("int")


def _index(entries: DataFrame, cuts: list[tuple[int, int]], high: int, per_block: int) -> tuple[DataFrame, DataFrame]:
    """The blocks (segment, high, subs) and their contents (segment, high, sub, blob) in pieces."""
    each = F.explode(F.array(*[F.struct(F.lit(j).alias("segment"), _segment("code", cut, high).alias("high")) for j, cut in enumerate(cuts)]))
    rows = entries.select("code", F.col("ids")[0].alias("first"), each.alias("s")).select("code", "first", "s.segment", "s.high")
    blocks = written(rows.groupBy("segment", "high").agg(F.count("*").alias("n")).select("segment", "high", F.ceil(F.col("n") / per_block).cast("int").alias("subs"), "n"), "blocks")
    n, total = blocks.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    named = rows.join(F.broadcast(blocks) if n <= BROADCAST_BLOCKS else blocks, ["segment", "high"]).withColumn("sub", F.pmod(F.xxhash64("code"), F.col("subs")).cast("int"))
    parts = partitions_for(total, 1 << 20, entries.sparkSession)
    dealt = named.select("segment", "high", "sub", "code", "first").repartition(parts, "segment", "high", "sub").sortWithinPartitions("segment", "high", "sub", "code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.column_stack([column(batch, c).to_numpy() for c in ("segment", "high", "sub")])
            cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)])
            names, blobs = [], []
            for a, b in zip(cuts, np.r_[cuts[1:], len(key)], strict=True):
                for at in range(a, b, PIECE):
                    part = batch.slice(at, min(b, at + PIECE) - at)
                    blobs.append(column(part, "code").to_numpy().tobytes() + column(part, "first").to_numpy().tobytes())
                    names.append(key[a])
            names = np.array(names, np.int32).reshape(-1, 3)
            yield pa.record_batch([*(pa.array(names[:, i]) for i in range(3)), pa.array(blobs, pa.binary())], names=["segment", "high", "sub", "blob"])

    return blocks, written(dealt.mapInArrow(lean(run), "segment int, high int, sub int, blob binary"), "index")


def _within(segment: int, cut: tuple[int, int], high: int, radius: int) -> F.Column:
    """The (segment, high) whose high bits are within the radius of those of q."""
    every = F.sequence(F.lit(0), F.lit((1 << min(high, cut[1])) - 1))
    near = F.filter(every, lambda x: F.bit_count(x.bitwiseXOR(_segment("q", cut, high))) <= radius)
    return F.transform(near, lambda x: F.struct(F.lit(segment).alias("segment"), x.alias("high")))


def _round(open_: DataFrame, blocks: DataFrame, index: DataFrame, cuts: list[tuple[int, int]], high: int, radius: int, k: int) -> DataFrame:
    """(q, code, first, distance): what the buckets at this radius add for open queries (q, far)."""
    near = [_within(j, cut, high, radius) for j, cut in enumerate(cuts)]
    sent = open_.select("q", "far", F.explode(F.concat(*near)).alias("b")).select("q", "far", "b.segment", "b.high").join(blocks, ["segment", "high"])
    sent = sent.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
    left = index.select("segment", "high", "sub", F.lit(0).alias("side"), F.lit(0).cast("long").alias("q"), F.lit(0).alias("far"), "blob")
    right = sent.select("segment", "high", "sub", F.lit(1).alias("side"), "q", "far", F.lit(None).cast("binary").alias("blob"))
    parts = int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(parts, -(-blocks.agg(F.coalesce(F.sum("subs"), F.lit(0))).first()[0] // 8))
    dealt = left.unionByName(right).withColumn("block", F.xxhash64("segment", "high", "sub")).repartition(parts, "block").sortWithinPartitions("segment", "high", "sub", "side")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: list[bytes] = []
        last, table, first = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.column_stack([column(batch, c).to_numpy() for c in ("segment", "high", "sub", "side")])
            cuts_at = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)])
            for a, b in zip(cuts_at.tolist(), np.r_[cuts_at[1:], len(key)].tolist(), strict=True):
                if tuple(key[a][:3]) != last:
                    blobs, last, table = [], tuple(key[a][:3]), None
                if not key[a][3]:
                    blobs += column(batch, "blob").slice(a, b - a).to_pylist()
                    continue
                if table is None:
                    codes, first = (np.concatenate(x) for x in zip(*(np.frombuffer(x, np.int64).reshape(2, -1) for x in blobs), strict=True))
                    table = CodeTable(codes.view(U64), cuts, int(last[0]))
                    codes_of, first_of = codes, first
                for at in range(a, b, QUERIES):
                    part = batch.slice(at, min(b, at + QUERIES) - at)
                    asked = column(part, "q").to_numpy()
                    best = (np.zeros(0, np.int64),) * 3
                    for who, place, distance, _ in table.found(asked.view(U64), radius, column(part, "far").to_numpy()):
                        rows = tuple(np.concatenate(x) for x in zip(best, (who, place, distance), strict=True))
                        keep = nearest(rows[0], rows[2], first_of[rows[1]], k + 1)
                        best = tuple(x[keep] for x in rows)
                    if len(best[0]):
                        yield pa.record_batch([pa.array(asked[best[0]]), pa.array(codes_of[best[1]]), pa.array(first_of[best[1]]), pa.array(best[2].astype(np.int32))], names=["q", "code", "first", "distance"])

    return dealt.drop("block").mapInArrow(lean(search), "q long, code long, first long, distance int")


def near_codes(entries: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(q, code, distance): the k + 1 codes of entries(code, ids) that are first by (distance, smallest id) for each code q of asked."""
    n = entries.count()
    cuts = segments(n)
    high = max(0, ceil(log2(max(1, n) / CODES)))
    blocks, index = _index(entries, cuts, high, CODES)
    best = None
    open_ = asked.select(F.col("code").alias("q"), F.lit(FAR).alias("far")).distinct()
    done: list[DataFrame] = []
    for radius in range(max(width for _, width in cuts) + 1):
        found = _round(open_, blocks, index, cuts, high, radius, k)
        rows = found if best is None else best.unionByName(found)
        by = Window.partitionBy("q").orderBy("distance", "first")
        ranked = rows.withColumn("n", F.row_number().over(by)).where(F.col("n") <= k + 1)
        best = written(ranked, "best")
        # closed: k + 1 codes, the last of them within what has been seen
        state = best.groupBy("q").agg(F.max(F.when(F.col("n") == k + 1, F.col("distance"))).alias("far"))
        state = written(open_.select("q").join(state, "q", "left").withColumn("far", F.coalesce("far", F.lit(FAR))), "open")
        open_ = state.where(F.col("far") >= len(cuts) * (radius + 1))
        left = open_.count()
        best = best.drop("n")
        if left and left < state.count():
            done.append(best.join(open_, "q", "left_anti"))
            best = best.join(open_.select("q"), "q", "left_semi")
        if not left:
            break
    for part in done:
        best = best.unionByName(part)
    return best.select("q", "code", "distance")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, neighbor_id, distance) of queries(vec_id, embedding) among vectors(vec_id, embedding)."""
    rows = written(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), code().alias("code")).where("vec_id is not null and code is not null"), "codes")
    asked = written(queries.select(F.col("vec_id").cast("long").alias("vec_id"), code().alias("code")).where("vec_id is not null and code is not null").distinct(), "asked")
    # the k + 1 smallest ids of each code; the window's limit is applied before rows are moved
    small = rows.distinct().withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    entries = written(small.groupBy("code").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "entries")
    found = near_codes(entries, asked, k)
    # of at most k + 1 codes with k + 1 ids each, the k + 1 nearest ids
    merged = found.join(entries, "code").select("q", "distance", F.explode("ids").alias("vec_id"))
    lists = merged.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "vec_id"))), 1, k + 1).alias("near"))
    out = asked.join(lists.withColumnRenamed("q", "code"), "code").select(F.col("vec_id").alias("query_id"), F.explode("near").alias("near")).where("near.vec_id <> query_id")
    out = out.groupBy("query_id", "near.vec_id").agg(F.min("near.distance").alias("distance"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return out.select("query_id", rank.alias("rank"), F.col("vec_id").alias("neighbor_id"), "distance").where(F.col("rank") <= k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))


ORACLE = """
WITH c AS (
    SELECT vec_id, [CASE WHEN x >= 0 THEN 1 ELSE 0 END FOR x IN embedding] AS b FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), p AS (
    SELECT q.vec_id AS query_id, r.vec_id AS neighbor_id,
        CAST(list_sum([CASE WHEN q.b[i] <> r.b[i] THEN 1 ELSE 0 END FOR i IN range(1, 65)]) AS INTEGER) AS distance
    FROM c q, c r WHERE q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank, neighbor_id, distance
FROM p QUALIFY rank <= 10
"""
