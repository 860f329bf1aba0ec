"""N-gram Jaccard join by count vectors.

Each document is the set of its distinct 5-word shingles (lower-cased A-Z; with fewer words the whole sequence; without words
the empty set, linked with nothing).  Two documents link when 100 * |A & B| >= percent * |A | B|.  The result is exact:

1. one pass names each set (128 bits), counts its shingles by hash into GROUPS groups - the set's *point* - and adds the
   shingles to a sketch of fixed size, of which frequent shingles are read;
2. a second pass sends each set's prefix, its ``n - ceil(percent/100 * n) + 1`` first shingles with frequent ones last, to the
   buckets of these shingles: two sets that link share a bucket;
3. an R-tree over the points of the buckets, in every search and for buckets of every size, bounds the overlap of two sets by the
   summed minima of their coordinates (for a node: of the query and the node's upper corner); only pairs whose bound reaches the
   needed overlap survive.  Small buckets share a tree, a subtree for each;
4. survivors are verified on the whole sets, and links become components by distributed union-find.

Null text is empty text.  Repeated rows and equal sets are one class and share a component.  A null doc_id is kept as a row;
a component's id is its smallest non-null doc_id.  Extra columns of the input are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _links
from ._core import U64, column, id_bytes, lean, partitions_for, read_table, set_ids, shingle_sets, slices, text_buffer, written

GROUP_BITS = 8
GROUPS = 1 << GROUP_BITS
#: Sets of more shingles than this have four times as many groups, beyond four times this sixteen times: the bound of a pair
#: of unrelated sets falls short of the similarity as long as the sets aren't much larger than their groups.
FINE = 2048
#: Cells of the frequency sketch; it only sets the order of shingles, so collisions cost time and never a link.
CELL_BITS = 20
SKETCH_PARTS = 64
#: Ids up to this number are broadcast to fetch their texts (1.6 MB); beyond it the texts are shuffled.
BROADCAST_IDS = 200_000
#: Points or nodes under a node of the tree.
LEAF = 16
#: In tiles of more members each one is first tried with two partners instead of one.
SMALL = 64


class CountRTree:
    """A packed R-tree over count vectors of one or more tiles; no node goes over a tile's end.

    Points are sorted by tile, by size into slabs and by their widest axis.  A node carries the upper corner of its points, their
    range of sizes and their range of groups; a tile has as many levels as its points ask for, one node over all of them at last.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, tile: np.ndarray | None = None, group: np.ndarray | None = None, leaf: int = LEAF):
        n = len(points)
        tile = np.zeros(n, np.int64) if tile is None else tile
        axis = points[:, int(points.var(0, dtype=np.float32).argmax())] if n else np.zeros(0)
        order = np.lexsort((sizes, tile))
        held = np.bincount(tile[order]) if n else np.zeros(0, np.int64)
        first = np.repeat(np.cumsum(held) - held, held)
        slab = np.maximum(leaf, leaf * np.ceil(np.sqrt(np.repeat(held, held) / leaf)).astype(np.int64))
        order = order[np.lexsort((axis[order], (np.arange(n) - first) // slab, tile[order]))]
        self.order, self.points, self.sizes, tile = order, points[order], sizes[order], tile[order]
        self.groups = group[order] if group is not None else np.arange(n)
        #: From the leaves up: corners, sizes, groups, the end of the points below, and the children of each node.
        self.levels: list[tuple] = []
        upper, low, high, g0, g1, end = self.points, self.sizes, self.sizes, self.groups, self.groups, np.arange(1, n + 1)
        while n and (not self.levels or len(upper) > len(held[held > 0])):
            at = np.arange(len(upper)) - np.searchsorted(tile, tile, "left")
            cut = np.flatnonzero(at % leaf == 0)
            children = np.r_[cut, len(upper)]
            upper, low, high = np.maximum.reduceat(upper, cut, 0), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            g0, g1, end, tile = np.minimum.reduceat(g0, cut), np.maximum.reduceat(g1, cut), end[children[1:] - 1], tile[cut]
            self.levels.append((upper, low, high, g0, g1, end, children))
        self.roots = tile

    def pairs(self, percent: int, chunk: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(left, right, bound): positions of all pairs of a tile, of different groups, whose bound reaches the similarity."""
        out = []
        root_of = np.repeat(np.arange(len(self.roots)), np.diff(np.r_[0, self.levels[-1][5]])) if self.levels else np.zeros(0, np.int64)
        per = 1024
        for a in range(0, len(self.points), per):
            q = np.arange(a, min(len(self.points), a + per))
            out += self._below(q, root_of[q], len(self.levels) - 1, percent, chunk)
        left, right, bound = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        return self.order[left], self.order[right], bound

    def _below(self, q: np.ndarray, node: np.ndarray, level: int, percent: int, chunk: int) -> list[tuple]:
        """Pairs of the queries q and the points below their nodes; in pieces, so that a batch of pairs stays small."""
        while level >= 0:
            upper, low, high, g0, g1, end, children = self.levels[level]
            keep = (end[node] > q + 1) & ~((g0[node] == g1[node]) & (g0[node] == self.groups[q]))
            q, node = q[keep], node[keep]
            keep = self._bounds(q, upper, low, high, node, percent) >= 0
            q, node = q[keep], node[keep]
            count = children[node + 1] - children[node]
            if count.sum() > chunk and len(q) > 1:
                half = len(q) // 2
                return [x for part in (slice(0, half), slice(half, None)) for x in self._below(q[part], node[part], level, percent, chunk)]
            at = np.arange(int(count.sum())) + np.repeat(children[node] - np.cumsum(count) + count, count)
            q, node, level = np.repeat(q, count), at, level - 1
        keep = (node > q) & (self.groups[node] != self.groups[q])
        q, node = q[keep], node[keep]
        bound = self._bounds(q, self.points, self.sizes, self.sizes, node, percent)
        keep = bound >= 0
        return [(q[keep], node[keep], bound[keep])]

    def _bounds(self, q: np.ndarray, upper: np.ndarray, low: np.ndarray, high: np.ndarray, node: np.ndarray, percent: int) -> np.ndarray:
        """The summed minima of points and nodes; -1 where they or the sizes rule the similarity out."""
        size = self.sizes[q]
        out = np.where((100 * high[node] >= percent * size) & (100 * size >= percent * low[node]), 0, -1)
        some = np.flatnonzero(out == 0)
        for at in np.array_split(some, -(-len(some) // 4096) or 1):
            bound = np.minimum(upper[node[at]], self.points[q[at]]).sum(1, dtype=np.int64)
            need = percent * (size[at] + np.maximum(low[node[at]], -(-percent * size[at] // 100)))
            out[at] = np.where(bound * (100 + percent) >= need, bound, -1)
        return out


def count_points(sets: list[np.ndarray]) -> list[bytes]:
    """Counts of each set's hashes by group: a byte for the bits of the group number, a byte for the width, the counts.

    Larger sets have finer groups, GROUPS, 4 * GROUPS or 16 * GROUPS; a finer point folds into a coarser one.
    """
    out = []
    for s in sets:
        bits = GROUP_BITS + (2 if len(s) > FINE else 0) + (2 if len(s) > 4 * FINE else 0)
        counts = np.bincount((s >> U64(64 - bits)).astype(np.int64), minlength=1 << bits)
        top = counts.max(initial=0)
        kind = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4
        out.append(bytes([bits, kind]) + counts.astype(f"<u{kind}").tobytes())
    return out


class Points:
    """The points of a tile: all at the coarsest resolution, larger sets also at the finer ones that they have."""

    def __init__(self, blobs: list[bytes]):
        fine = [np.frombuffer(b, f"<u{b[1]}", offset=2) for b in blobs]
        bits = np.array([b[0] for b in blobs])
        self.coarse = self._fold(fine, GROUP_BITS)
        self.finer = []
        for level in (GROUP_BITS + 2, GROUP_BITS + 4):
            some = np.flatnonzero(bits >= level)
            if len(some) > 1:
                place = np.full(len(blobs), -1)
                place[some] = np.arange(len(some))
                self.finer.append((place, self._fold([fine[i] for i in some], level)))

    @staticmethod
    def _fold(points: list[np.ndarray], bits: int) -> np.ndarray:
        folded = [p if len(p) == 1 << bits else p.reshape(1 << bits, -1).sum(1) for p in points]
        kind = np.uint8 if max(p.max() for p in folded) < 1 << 8 else np.uint32
        return np.stack([p.astype(kind, copy=False) for p in folded])

    def refine(self, left: np.ndarray, right: np.ndarray, least: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs whose bound at every common finer resolution still reaches the similarity, and their least bounds."""
        for place, points in self.finer:
            a, b = place[left], place[right]
            keep = np.ones(len(left), bool)
            both = np.flatnonzero((a >= 0) & (b >= 0))
            for at in np.array_split(both, -(-len(both) // 4096) or 1):
                bound = np.minimum(points[a[at]], points[b[at]]).sum(1, dtype=np.int64)
                keep[at] = bound * (100 + percent) >= percent * (n[left[at]] + n[right[at]])
                least[at] = np.minimum(least[at], bound)
            left, right, least = left[keep], right[keep], least[keep]
        return left, right, least


def _hubs(left: np.ndarray, right: np.ndarray, score: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each member the partner that most others may link with, too; in tiles of more than SMALL members also the best one."""
    a, b, score = np.r_[left, right], np.r_[right, left], np.r_[score, score]
    degree = np.bincount(a)
    out = []
    for rank, some in ((-degree[b], np.ones(len(a), bool)), (-score, sizes[a] > SMALL)):
        x, y = a[some], b[some]
        order = np.lexsort((y, rank[some], x))
        x, y = x[order], y[order]
        first = np.r_[True, x[1:] != x[:-1]] if len(x) else np.zeros(0, bool)
        out.append((x[first], y[first]))
    a, b = (np.concatenate(x) for x in zip(*out, strict=True))
    pairs = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0)
    return pairs[:, 0], pairs[:, 1]


def searcher(percent: int) -> _links.Search:
    def search(n: np.ndarray, feats: list, tile: np.ndarray, group: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        points = Points(feats)
        left, right, bound = CountRTree(points.coarse, n, tile, group).pairs(percent)
        left, right, bound = points.refine(left, right, bound, n, percent)
        if group is None and len(left):
            return _hubs(left, right, bound / (n[left] + n[right]), np.bincount(tile)[tile])
        return left, right

    return search


FOUND = "doc_id long, n long, id binary, point binary, cells int, counts binary"


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """Each row's set and the sketch; a column row is carried along."""
    carried = "row" in docs.columns
    schema = FOUND + ", row long" * carried

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << CELL_BITS, np.uint32)
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in slices(batches, "text"):
            sets = shingle_sets(*text_buffer(column(batch, "text")), width)
            k = len(sets)
            flat = np.concatenate(sets)
            sketch += np.bincount((flat >> U64(64 - CELL_BITS)).astype(np.int64), minlength=1 << CELL_BITS).astype(np.uint32)
            yield pa.record_batch([column(batch, "doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), id_bytes(set_ids(sets)), pa.array(count_points(sets), pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), *[column(batch, "row")] * carried], names=names)
        rows = list(enumerate(sketch.reshape(SKETCH_PARTS, -1)))
        rows = [(i, x.tobytes()) for i, x in rows if x.any()]
        k = len(rows)
        yield pa.record_batch([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()), pa.array([i for i, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary()), *[pa.nulls(k, pa.int64())] * carried], names=names)

    return docs.select("doc_id", "text", *["row"] * carried).mapInArrow(lean(scan), schema)


def _levels(found: DataFrame) -> np.ndarray:
    """A byte for each cell: 0 for the usual count, else the bits of what it has beyond that.  Of fixed size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(blob.as_buffer(), np.uint32)
                sums[i] = sums[i] + x if i in sums else x.astype(np.int64)
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["cells", "counts"])

    rows = found.where("cells is not null").select("cells", "counts").repartition(SKETCH_PARTS, "cells").mapInArrow(lean(add), "cells int, counts binary").collect()
    counts = np.zeros((SKETCH_PARTS, (1 << CELL_BITS) // SKETCH_PARTS), np.int64)
    for row in rows:
        counts[row.cells] = np.frombuffer(row.counts, np.int64)
    counts = counts.ravel()
    usual = float(np.median(counts))
    beyond = counts - usual
    return np.where(beyond > 6 * np.sqrt(usual) + 6, np.ceil(np.log2(np.maximum(beyond, 1))) + 1, 0).astype(np.uint8)


def _salts() -> np.ndarray:
    """Ranges that a shingle is dealt to by its level, the bits of its cell's count."""
    return np.array([max(1, (1 << max(0, x - 1)) // _links.SPLIT) for x in range(64)], np.int64)


def _entries(docs: DataFrame, levels: np.ndarray, width: int, percent: int, parts: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    salts = _salts()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen = shared.value, set()
        held: list = []
        weight = 0
        for batch in slices(batches, "text"):
            sets = shingle_sets(*text_buffer(column(batch, "text")), width)
            ids = set_ids(sets)
            for s, i in zip(sets, ids, strict=True):
                if not len(s) or (name := i.tobytes()) in seen:
                    continue
                if len(seen) < 1 << 20:
                    seen.add(name)
                take = len(s) - -(-percent * len(s) // 100) + 1
                rank = level[(s >> U64(64 - CELL_BITS)).astype(np.int64)]
                first = s[np.argsort(rank, kind="stable")[:take]] if rank.any() else s[:take]
                held.append((first, i, len(s), (np.arange(take) * 256 // len(s)).astype(np.uint8), salts[level[(first >> U64(64 - CELL_BITS)).astype(np.int64)]]))
                weight += take
            if weight > 1 << 20:
                yield _blobs(held, parts)
                held, weight = [], 0
        if held:
            yield _blobs(held, parts)

    return docs.select("text").mapInArrow(lean(scan), _links.ENTRY)


def _blobs(held: list, parts: int) -> pa.RecordBatch:
    keys = np.concatenate([x[0] for x in held])
    owner = np.repeat(np.arange(len(held)), [len(x[0]) for x in held])
    return _links.pack(keys, owner, np.array([x[1] for x in held]), parts, np.array([x[2] for x in held]), np.concatenate([x[3] for x in held]), np.concatenate([x[4] for x in held]))


def _verify(docs: DataFrame, classes: DataFrame, width: int, percent: int):
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(*text_buffer(column(batch, "text")), width)
            yield pa.record_batch([id_bytes(set_ids(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "blob"])

    def verify(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("a").alias("num")).union(pairs.select(F.col("b").alias("num"))).distinct()
        wanted = written(classes.join(ids, "num", "left_semi").select("id", "num", "anchor"), "wanted")
        anchors = wanted.select("anchor").distinct()
        if wanted.count() <= BROADCAST_IDS:
            anchors = F.broadcast(anchors)
        texts = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("anchor"), "text").join(anchors, "anchor", "left_semi")
        sets = texts.select("text").mapInArrow(lean(whole), "id binary, blob binary").join(wanted.select("id", F.col("num")), "id")
        return _links.verified(pairs, written(sets.select(F.col("num").alias("id"), "blob").dropDuplicates(["id"]), "sets"), percent)

    return verify


def _components(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows of docs with their sets, and (id, num, least, root) of the distinct sets; docs: doc_id long, text string, row if wanted."""
    spark = docs.sparkSession
    found = written(_sets(docs, width), "sets")
    rows = found.where("n is not null")
    classes = written(rows.where("n > 0").groupBy("id").agg(F.min("doc_id").alias("least"), F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("anchor"), F.first("point").alias("feature")).withColumn("num", F.monotonically_increasing_id()), "classes")
    total = rows.agg(F.sum("n")).first()[0] or 0
    parts = partitions_for(total * (100 - percent) // 100, 1_000_000, spark)
    levels = _levels(found)
    live = _links.live_buckets(_entries(docs, levels, width, percent, parts), classes, parts, percent, bool(_salts()[levels].max() > 1))
    comps = _links.resolve(live, classes.select(F.col("num").alias("id"), "feature"), searcher(percent), _verify(docs, classes, width, percent))
    comps = comps.withColumnRenamed("id", "num")
    named = classes.select("id", "num", "least").join(comps, "num", "left").withColumn("root", F.coalesce("root", "num"))
    return rows, named


def ngram_jaccard_join(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of docs(doc_id, text)."""
    rows, named = _components(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), width, percent)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    names = written(named.select("id", "root").join(least, "root").select("id", "component_id"), "names")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "id").join(names, "id", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(read_table(spark, sf_dir, "documents"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """docs with one document of each component, that of the smallest (doc_id, hash of the text); rows without a doc_id or words stay.

    A document is a doc_id and a text: rows that repeat both count as one and stay once, another text of the doc_id is another document.
    """
    row = F.xxhash64(F.col("text").cast("string"))
    rows, named = _components(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row.alias("row")), width, percent)
    ids, place = rows.where("doc_id is not null"), F.struct("doc_id", "row")
    worded = ids.where("n > 0")
    first = written(named.select("id", "root").join(worded.groupBy("id").agg(F.min(place).alias("place")), "id"), "first")
    keepers = first.groupBy("root").agg(F.min("place").alias("keeper"))
    names = written(first.select("id", "root").join(keepers, "root").select("id", "keeper"), "names")
    gone = written(worded.select("id", "doc_id", "row").join(names, "id").where(place != F.col("keeper")).select("doc_id", F.col("row").alias("__row")).distinct(), "gone")
    again = written(ids.groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    kept = docs.withColumn("__row", row).join(gone, ["doc_id", "__row"], "left_anti").drop("__row")
    n = again.count()
    if not n:
        return kept.select(docs.columns)
    if n <= BROADCAST_IDS:
        again = F.broadcast(again)
    twice = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(twice.select(docs.columns))
