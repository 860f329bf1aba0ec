"""Conflict-constrained best-fit packing of documents into bins of CAPACITY tokens.

A document of more tokens than a bin gives as many full pieces as it can, each a bin of its own, and its rest is packed; so no
token is lost.  Items are written once and dealt by the hash of their key and place into shards of about SHARD_ITEMS, whatever
their source or cluster (rows that repeat a document spread over all shards), and each shard is packed on its own, largest items
first:

* bins are kept by their residual, with a bitmap of the residuals that occur, and carry bitmaps of the sources they hold once
  and as often as allowed, and of the duplicate clusters they hold;
* an item goes to the tightest bin that takes it: the successor search starts at its own size and goes on, bin by bin and
  residual by residual, until a bin has no conflict; without one, a new bin is opened;
* items of one size, source and cluster come one after another and share a search: a bin that has refused one of them refuses
  the others too, so the search goes on where the last one ended.

No bin holds two items of a duplicate cluster or more than per_source items of a source.  Unless given, per_source is PER_SOURCE
or, where one source has most items, twice what that source would have in a bin of average items, so that it doesn't leave bins
half empty.  The cluster of a row is a given column or else the hash of its text.  Tokens are words between white space unless a column is given; a row without tokens (null
or empty text) gets a row without a bin.  A null source is a source of its own.  Repeated rows are items like others and, being
of one cluster, never meet.  A null doc_id is kept; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._core import column, lean, partitions_for, read_table, written
from .mixing import token_count

CAPACITY, PER_SOURCE, SHARD_ITEMS = 2048, 2, 4096


class Packer:
    """Bins of one shard."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by residual
        self.residuals = 0  # bit r: a bin with residual r is open
        self.levels: list[list[int]] = []  # of each bin: bitmaps of the sources that it holds 1, 2, ... times
        self.clusters: list[int] = []
        self.fill: list[int] = []  # items in each bin

    def new_bin(self) -> int:
        self.levels.append([0] * self.per_source)
        self.clusters.append(0)
        self.fill.append(0)
        return len(self.fill) - 1

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, slot) of an item; source and cluster are bits (a cluster of 0 has no conflicts in this shard)."""
        return self.place_alike(size, source, cluster, 1)[0]

    def place_alike(self, size: int, source: int, cluster: int, n: int) -> list[tuple[int, int]]:
        """(bin, slot) of n items of one size, source and cluster, as place would give them one after another.

        With a cluster no bin takes two of them and a refusal lasts, so one walk over the bins serves them all.
        """
        if n > 1 and not cluster:
            return [self.place(size, source, cluster) for _ in range(n)]
        taken: list[tuple[int, int]] = []
        left = self.residuals >> size
        at = size
        while left and len(taken) < n:
            step = (left & -left).bit_length() - 1
            at += step
            bins = self.open[at]
            i = len(bins) - 1
            while i >= 0 and len(taken) < n:
                b = bins[i]
                if not (self.levels[b][-1] & source or self.clusters[b] & cluster):
                    bins[i] = bins[-1]
                    bins.pop()
                    taken.append((b, at - size))
                i -= 1
            if not bins:
                self.residuals &= ~(1 << at)
            left >>= step + 1
            at += 1
        out = [self._put(b, rest, source, cluster) for b, rest in taken]
        return out + [self._put(self.new_bin(), self.capacity - size, source, cluster) for _ in range(n - len(taken))]

    def _put(self, b: int, residual: int, source: int, cluster: int) -> tuple[int, int]:
        levels = self.levels[b]
        for i, level in enumerate(levels):
            if not level & source:
                levels[i] = level | source
                break
        self.clusters[b] |= cluster
        slot = self.fill[b]
        self.fill[b] += 1
        if residual:
            self.open[residual].append(b)
            self.residuals |= 1 << residual
        return b, slot


OUT = "doc_id long, source string, cluster long, piece int, start_token long, n_tokens long, bin_id long, slot int"


def _shard(items: list[tuple], capacity: int, per_source: int) -> Iterator[tuple]:
    """(piece, start, size, bin, slot) for items (tokens, source, cluster), given with the largest rests first; by item."""
    packer = Packer(capacity, per_source)
    sources: dict[str | None, int] = {}
    seen: set[int] = set()
    twice: dict[int, int] = {}
    for _, _, cluster in items:
        if cluster in seen:
            twice.setdefault(cluster, 1 << len(twice))
        seen.add(cluster)
    for (rest, source, cluster), alike in groupby(items, lambda x: (x[0] % capacity, x[1], x[2])):
        run = list(alike)
        bit = sources.setdefault(source, 1 << len(sources))
        placed = packer.place_alike(rest, bit, twice.get(cluster, 0), len(run)) if rest else [None] * len(run)
        for (tokens, *_), place in zip(run, placed, strict=True):
            full = tokens // capacity
            out = [(piece, piece * capacity, capacity, packer.new_bin(), 0) for piece in range(full)]
            if place:
                out.append((full, full * capacity, rest, *place))
            yield out or [(0, 0, 0, None, None)]


#: Shards that a partition has on average, beyond the session's own number of partitions.
SHARDS_TOGETHER = 32


def _per_source(items: DataFrame, capacity: int) -> int:
    """Twice the items that the most frequent source would have in a bin of average items; PER_SOURCE at least."""
    rests = items.select("source", (F.col("tokens") % capacity).alias("rest")).where("rest > 0")
    n, total, most = rests.groupBy("source").agg(F.count("*").alias("n"), F.sum("rest").alias("t")).agg(F.sum("n"), F.sum("t"), F.max("n")).first()
    return max(PER_SOURCE, -(-2 * most * capacity // total)) if n else PER_SOURCE


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int | None = None, tokens: str | None = None, cluster: str | None = None, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """A row for each piece: (doc_id, source, cluster, piece, start_token, n_tokens, bin_id, slot)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        (F.xxhash64(F.col(cluster)) if cluster else F.xxhash64(text)).alias("cluster"),
        (F.col(tokens).cast("long") if tokens else token_count()).alias("tokens"),
        F.xxhash64(F.lit(5), F.col("doc_id").cast("long"), text, F.monotonically_increasing_id()).alias("key"),
    )
    rows = written(rows, "items")
    per_source = per_source or _per_source(rows, capacity)
    count = rows.count()
    shards = max(1, -(-count // shard_items))
    rows = rows.withColumn("shard", F.pmod(F.col("key"), F.lit(shards)))
    parts = partitions_for(count, shard_items * SHARDS_TOGETHER, spark)
    dealt = rows.repartition(parts, "shard").sortWithinPartitions("shard", F.desc(F.col("tokens") % capacity), "source", "cluster", "key", "doc_id")
    names = [x.split()[0] for x in OUT.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "int": pa.int32()}[x.split()[1]] for x in OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None

        def done() -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            for item, pieces in zip(held, _shard([x[1:] for x in held], capacity, per_source), strict=True):
                for piece, start, size, b, slot in pieces:
                    out.append((item[0], item[2], item[3], piece, start, size, None if b is None else last << 32 | b, slot))
                if len(out) >= 8192:
                    yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out = []
            if out:
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            columns = [column(batch, c).to_pylist() for c in ("shard", "doc_id", "tokens", "source", "cluster")]
            for shard, *item in zip(*columns, strict=True):
                if shard != last:
                    if held:
                        yield from done()
                    held, last = [], shard
                held.append(tuple(item))
        if held:
            yield from done()

    return dealt.mapInArrow(lean(run), OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
