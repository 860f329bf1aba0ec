"""Links between set classes: packed bucket shuffle, search inside buckets, exact check, distributed union-find.

A *class* is all rows with the same set.  Map tasks name it by 16 bytes; in the table of classes it also has a number (a long),
by which everything after the buckets knows it.  Map tasks write (key, class) entries as packed blobs, one for each hash range
of keys and batch, so that an entry costs some 14 bytes of shuffle.  A reducer keeps the keys that at least two classes hold
("buckets"), and of buckets with the same members one.  Members of a bucket are then compared; what passes the exact check is a
link.

Hot keys.  A key that more than SPLIT classes hold, as counts taken beforehand say, is dealt by key and owner, so that no reducer
holds all its entries.  A bucket beyond BLOCK members is cut into blocks.  At first each block is searched with some
REPRESENTATIVES of the bucket, which joins nearly all of a group of near copies with work in proportion to the group; then blocks
are searched in pairs, but only where the pair still holds different components: members of one component never meet again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._core import U64, column, discard, jaccard_at_least, lean, mix, written

#: A larger bucket than this is cut into blocks; no task holds more than two blocks and the representatives.
BLOCK = 1024
#: Members of a large bucket, on average, that each of its blocks is searched with at first.
REPRESENTATIVES = 64
#: Entries of a key beyond which it is dealt by its owners, too.
SPLIT = 1 << 16
ENTRIES = pa.schema([("part", pa.int32()), ("split", pa.bool_()), ("blob", pa.binary())])
ENTRY = "part int, split boolean, blob binary"


def _short(keys: np.ndarray) -> bytes:
    """The low 48 bits of each key: they only gather candidates, so that equal ones of different keys cost time, not truth."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def pack(keys: np.ndarray, owner: np.ndarray, ids: np.ndarray, parts: int, sizes: np.ndarray | None = None, place: np.ndarray | None = None, salts: np.ndarray | None = None) -> pa.RecordBatch:
    """Entries (key, owner) as one blob for each hash range of keys; an owner is named by the first half of its id.

    place: a byte for each entry, the key's rank among the owner's keys in 256ths of its size, rounded down.  Without sizes
    each entry names its owner itself, which is shorter where an owner has few keys.  salts: for each entry the number of
    ranges that its key is dealt to by owner; such keys have blobs of their own.
    """
    at = keys
    split = np.zeros(len(keys), bool) if salts is None else salts > 1
    if split.any():
        salt = mix(ids[owner, 1] + U64(0xC2B2AE3D27D4EB4F)) % np.maximum(salts, 1).astype(U64)
        at = np.where(split, mix((keys & U64((1 << 48) - 1)) + salt * U64(0x9E3779B97F4A7C15)), keys)
    part = ((at & U64(0xFFFFFFFF)) * U64(parts) >> U64(32)).astype(np.int32)
    order = np.lexsort((split, part)) if split.any() else np.argsort(part, kind="stable")
    keys, owner, part, split = keys[order], owner[order], part[order], split[order]
    place = None if place is None else place[order]
    cuts = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (split[1:] != split[:-1])]) if len(part) else np.zeros(0, np.int64)
    names, kinds, blobs = [], [], []
    for a, b in zip(cuts, np.r_[cuts[1:], len(part)], strict=True):
        if sizes is None:
            blobs.append(np.array([b - a, 0], np.int64).tobytes() + ids[owner[a:b], 0].tobytes() + _short(keys[a:b]))
        else:
            own, local = np.unique(owner[a:b], return_inverse=True)
            blobs.append(np.array([b - a, len(own)], np.int64).tobytes() + ids[own, 0].tobytes() + sizes[own].astype(np.uint32).tobytes() + local.astype(np.uint32).tobytes() + place[a:b].tobytes() + _short(keys[a:b]))
        names.append(int(part[a]))
        kinds.append(bool(split[a]))
    return pa.record_batch([pa.array(names, pa.int32()), pa.array(kinds, pa.bool_()), pa.array(blobs, pa.binary())], schema=ENTRIES)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, owners, sizes and ranks of a blob's entries."""
    n, m = np.frombuffer(blob, np.int64, 2)
    at = 16
    if not m:
        owner, size, place = np.frombuffer(blob, U64, n, at), np.ones(n, np.uint32), np.zeros(n, np.uint8)
        at += 8 * n
    else:
        ids, sizes = np.frombuffer(blob, U64, m, at), np.frombuffer(blob, np.uint32, m, at + 8 * m)
        local = np.frombuffer(blob, np.uint32, n, at + 12 * m)
        place = np.frombuffer(blob, np.uint8, n, at + 12 * m + 4 * n)
        owner, size = ids[local], sizes[local]
        at += 12 * m + 5 * n
    keys = np.zeros((n, 8), np.uint8)
    keys[:, :6] = np.frombuffer(blob, np.uint8, 6 * n, at).reshape(-1, 6)
    return keys.view("<u8").ravel(), owner, size, place


def _partnered(owner_size: np.ndarray, place: np.ndarray, cut: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
    """Which entries of buckets have a partner in their bucket that their sizes and ranks allow.

    A shared key that is the first one of two sets leaves min(|A| - rank, |B| - rank) keys to share at most.  A pair that this
    refuses in one bucket, though it links, is allowed in the bucket of its first shared key.
    """
    keep = np.ones(len(owner_size), bool)
    left = owner_size - (place.astype(np.int64) * owner_size >> 8)
    for k in np.unique(size[(size > 1) & (size <= 1024)]).tolist():
        some, step = cut[size == k], max(1, (1 << 21) // k**2)
        for a in range(0, len(some), step):
            at = some[a : a + step, None] + np.arange(k)
            n, rest = owner_size[at], left[at]
            fits = 100 * np.minimum(n[:, :, None], n[:, None, :]) >= percent * np.maximum(n[:, :, None], n[:, None, :])
            fits &= np.minimum(rest[:, :, None], rest[:, None, :]) * (100 + percent) >= percent * (n[:, :, None] + n[:, None, :])
            fits[:, np.arange(k), np.arange(k)] = False
            keep[at] = fits.any(2)
    return keep


LIVE = "bucket long, half binary, n long, bsize long"


def live_buckets(entries: DataFrame, classes: DataFrame, parts: int, percent: int, hot: bool) -> DataFrame:
    """Rows (bucket, id, n, bsize) of the keys that at least two fitting classes hold; equal member sets are one bucket.

    classes: (id, num); a half id that two classes share stands for both.  The ids of the result are the numbers; bsize is the
    number of the bucket's members.  hot: whether any key is dealt by its owners, so that its members must be counted afterwards.
    """

    def members(bucket: np.ndarray, owner: np.ndarray, n: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        half = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8), len(owner), [None, pa.py_buffer(owner.astype(">u8").tobytes())]).cast(pa.binary())
        return pa.record_batch([pa.array(bucket), half, pa.array(n.astype(np.int64)), pa.array(size)], names=["bucket", "half", "n", "bsize"])

    def shared(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Buckets of keys whose entries are all here."""
        key, owner, n, place = (np.concatenate([h[i] for h in held]) for i in range(4))
        order = np.argsort(key, kind="stable")
        same = key[order]
        same = same[1:] == same[:-1]
        touched = np.zeros(len(key), bool)
        touched[1:] |= same
        touched[:-1] |= same
        order = order[touched]
        key, owner, n, place = key[order], owner[order], n[order].astype(np.int64), place[order]
        if not len(key):
            return
        order = np.lexsort((owner, key))
        key, owner, n, place = key[order], owner[order], n[order], place[order]
        keep = np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]
        for _ in range(3):
            key, owner, n, place = key[keep], owner[keep], n[keep], place[keep]
            if not len(key):
                return
            cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[cut, len(key)])
            keep = np.repeat(size > 1, size)
            if percent:
                keep &= _partnered(n, place, cut, size, percent)
        some = np.flatnonzero(size > 1)
        if not len(some):
            return
        # members name the bucket: what several keys gather alike is one bucket
        # (two buckets of one name, if that should happen, are searched together)
        group = np.add.reduceat(mix(owner + U64(0x9E6C63D0676A9A99)), cut).view(np.int64)
        some = some[np.unique(group[some], return_index=True)[1]]
        total = np.cumsum(size[some])
        at = 0
        while at < len(some):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 17), "right")))
            now = some[at:to]
            rows = np.arange(int(size[now].sum())) + np.repeat(cut[now] - np.cumsum(size[now]) + size[now], size[now])
            yield members(np.repeat(group[now], size[now]), owner[rows], n[rows], np.repeat(size[now], size[now]))
            at = to

    def dealt(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Entries of keys whose other owners are elsewhere: the key names the bucket."""
        key, owner, n, _ = (np.concatenate([h[i] for h in held]) for i in range(4))
        order = np.lexsort((owner, key))
        key, owner, n = key[order], owner[order], n[order]
        keep = np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]
        yield members(mix(key[keep] + U64(0xD1342543DE82EF95)).view(np.int64), owner[keep], n[keep], np.full(int(keep.sum()), -1))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None
        for batch in batches:  # sorted by part: a range of keys at a time
            for part, split, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if (part, split) != last and held:
                    yield from (dealt if last[1] else shared)(held)
                    held = []
                last = (part, split)
                held.append(_unpack(blob.as_buffer()))
        if held:
            yield from (dealt if last[1] else shared)(held)

    found = entries.repartition(parts, "part").sortWithinPartitions("part", "split").mapInArrow(lean(reduce), LIVE).dropDuplicates(["bucket", "half"])
    out = written(found.join(classes.select(F.col("num").alias("id"), F.substring(F.col("id"), 1, 8).alias("half")), "half").drop("half"), "live")
    if not hot:
        return out
    dealt_rows = out.where("bsize < 0").drop("bsize")
    # written: above its own exchange the count would keep the join from splitting a hot bucket
    sizes = written(dealt_rows.groupBy("bucket").agg(F.count("*").alias("bsize")).where("bsize > 1"), "sizes")
    return written(out.where("bsize > 0").unionByName(dealt_rows.join(sizes, "bucket")), "live")


#: From sizes, features, tile numbers and, for the second search, component numbers: positions of the pairs to verify.  Without
#: component numbers (the first search) a few pairs for each member that will join most of a group.
Search = Callable[[np.ndarray, list, np.ndarray, np.ndarray | None], tuple[np.ndarray, np.ndarray]]


def _any_large(live: DataFrame) -> bool:
    return bool(live.where(F.col("bsize") > BLOCK).limit(1).count())


def _first_tiles(live: DataFrame, large: bool) -> DataFrame:
    """Rows of tiles (bucket, ta, tb): small buckets whole, of large ones each block with the representatives of the others."""
    whole = live.where(F.col("bsize") <= BLOCK).withColumns({"ta": F.lit(0).cast("long"), "tb": F.lit(0).cast("long"), "side": F.lit(0)})
    if not large:
        return whole
    big = live.where(F.col("bsize") > BLOCK).withColumn("blocks", F.ceil(F.col("bsize") / BLOCK)).withColumn("ta", F.pmod(F.xxhash64("id"), F.col("blocks")))
    chosen = big.where(F.pmod(F.xxhash64("id", "bucket"), F.col("bsize")) < REPRESENTATIVES)
    chosen = chosen.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("other <> ta")
    rows = big.withColumn("side", F.lit(0)).unionByName(chosen.drop("ta").withColumnRenamed("other", "ta").withColumn("side", F.lit(1)))
    return whole.unionByName(rows.drop("blocks").withColumn("tb", F.col("ta")))


def _second_tiles(live: DataFrame, comps: DataFrame, large: bool) -> DataFrame:
    """Rows of the tiles that still hold different components, with comp: small buckets whole, of large ones pairs of blocks.

    Blocks of a large bucket hold either one component or many small ones.  The bucket's largest component is only paired with
    what is not of it, so its blocks never meet each other, and rows grow with it times the blocks of the rest.
    """
    named = live.join(comps, "id", "left").withColumn("comp", F.coalesce("root", "id")).drop("root")
    whole = named.where(F.col("bsize") <= BLOCK)
    mixed = whole.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("bucket")
    whole = whole.join(mixed, "bucket").withColumns({"ta": F.lit(0).cast("long"), "tb": F.lit(0).cast("long"), "side": F.lit(0)})
    if not large:
        return whole
    big = named.where(F.col("bsize") > BLOCK)
    counts = written(big.groupBy("bucket", "comp").agg(F.count("*").alias("members")), "members")
    totals = counts.groupBy("bucket").agg(F.sum(F.when(F.col("members") <= BLOCK, F.col("members")).otherwise(0)).alias("pool"), F.max(F.struct("members", "comp")).alias("most"), F.count("*").alias("comps")).where("comps > 1")
    own = F.when(F.col("members") > BLOCK, F.xxhash64("comp", F.pmod(F.xxhash64("id"), F.ceil(F.col("members") / BLOCK)))).otherwise(F.pmod(F.xxhash64("comp"), F.ceil(F.col("pool") / BLOCK)))
    alone = F.when(F.col("members") > BLOCK, F.col("comp"))
    placed = big.join(counts, ["bucket", "comp"]).join(totals.select("bucket", "pool", F.col("most.comp").alias("main")), "bucket")
    placed = written(placed.withColumns({"block": own, "alone": alone}).drop("members", "pool"), "placed")
    blocks = placed.groupBy("bucket", "block").agg(F.first("alone").alias("alone"), F.coalesce(F.first("alone") == F.first("main"), F.lit(False)).alias("of_main"))
    rest = blocks.where("not of_main").select("bucket", F.col("block").alias("tb"), F.col("alone").alias("alone_b"))
    pairs = blocks.withColumnRenamed("block", "ta").join(rest, "bucket").where("of_main or ta < tb or ta = tb and alone is null").where("alone is null or alone_b is null or alone <> alone_b")
    pairs = written(pairs.select("bucket", "ta", "tb"), "block_pairs")
    left = placed.withColumnRenamed("block", "ta").join(pairs, ["bucket", "ta"]).withColumn("side", F.lit(0))
    right = placed.withColumnRenamed("block", "tb").join(pairs.where("ta <> tb"), ["bucket", "tb"]).withColumn("side", F.lit(1))
    return whole.unionByName(left.unionByName(right).select(whole.columns))


#: Rows of small tiles that are worked on together.
TOGETHER = 2048


def _by_tile(tiles: DataFrame, work: Callable[[pa.RecordBatch, np.ndarray], list[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """(a, b) of each tile's work; a task holds a few small tiles or a large one at a time.

    work gets rows and the bounds of the tiles in them.  Tiles are dealt by a hash of their own: dealt by their key columns, a
    join before could stand in for the exchange, and its skewed partitions, split at run time, would tear tiles apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def done() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            key = np.column_stack([column(table, x).to_numpy() for x in ("bucket", "ta", "tb")])
            cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1), True])
            found = work(table, cuts)
            if found:
                a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.column_stack([column(batch, x).to_numpy() for x in ("bucket", "ta", "tb")])
            starts = np.flatnonzero(np.r_[last is None or (key[0] != last).any(), (key[1:] != key[:-1]).any(1)])
            last = key[-1]
            at = 0
            for cut in starts.tolist():
                if rows + cut - at >= TOGETHER:  # enough, and a tile begins here
                    if cut > at:
                        held.append(batch.slice(at, cut - at))
                    yield from done()
                    held, rows, at = [], 0, cut
            held.append(batch.slice(at))
            rows += batch.num_rows - at
        if held:
            yield from done()

    # without a number of its own the exchange is coalesced by size, never split
    dealt = tiles.withColumn("tile", F.xxhash64("bucket", "ta", "tb")).repartition("tile").sortWithinPartitions("bucket", "ta", "tb", "id")
    return dealt.mapInArrow(lean(run), "a long, b long")


def _pairs(tiles: DataFrame, feature: DataFrame, search: Search, first: bool) -> DataFrame:
    """Candidate pairs (a, b) of every tile, a < b: a few for each member at first, then all between components.

    feature: (id, feature) of every id, joined to the rows of the tiles for the search.
    """

    def work(table: pa.RecordBatch, cuts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        ids, side, n = (column(table, x).to_numpy() for x in ("id", "side", "n"))
        tile = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        group = None if first else np.unique(column(table, "comp").to_numpy(), return_inverse=True)[1]
        left, right = search(n, column(table, "feature").to_pylist(), tile, group)
        if not first:
            two = column(table, "ta").to_numpy() != column(table, "tb").to_numpy()
            keep = ~two[left] | (side[left] != side[right])  # pairs within a block are another tile's work
            left, right = left[keep], right[keep]
        return [(ids[left], ids[right])] if len(left) else []

    return _by_tile(tiles.join(feature, "id"), work).distinct()


#: The sorted distinct hashes of each text.
Sets = Callable[[list[bytes]], list[np.ndarray]]
#: Questions of a tile that are answered by searching the member's set, before an inverted list is made for the others.
SEARCHED = 12
SLOTS = 1 << 13


def components_of_sets(live: DataFrame, texts: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """(id, root): components over all links of members of the same bucket whose sets reach the similarity.

    texts: (id, text) of every id.  Tiles are searched whole, with every member's
    overlaps, so the first search is the last one for buckets of one block.
    """
    large = _any_large(live)
    links = written(_links_of_tiles(_first_tiles(live, large), texts, sets, percent, False), "links")
    comps = components(links)
    if not large:
        return comps
    more = written(_links_of_tiles(_second_tiles(live.where(F.col("bsize") > BLOCK), comps, True), texts, sets, percent, True), "links")
    return components(links.unionByName(more)) if more.limit(1).count() else comps


def _links_of_tiles(tiles: DataFrame, texts: DataFrame, sets: Sets, percent: int, grouped: bool) -> DataFrame:
    """Links (a, b) that join, within each tile, all members whose sets reach the similarity by pairs.

    Members are asked for their overlaps with all others until those not yet asked are all joined already: every pair of a tile is
    compared then or joined by others, and a group of near copies takes one question and those of its outsiders.  Members of one
    component (grouped) are joined from the start.
    """

    def work(table: pa.RecordBatch, cuts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        ids = column(table, "id").to_numpy()
        _, first, back = np.unique(ids, return_index=True, return_inverse=True)
        every = sets([x.as_buffer().to_pybytes() for x in column(table, "text").take(pa.array(first))])
        comp = column(table, "comp").to_numpy() if grouped else None
        left, right = [], []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            held = [every[i] for i in back[a:b]]
            if b - a == 2:
                pairs = [(0, 1)] if jaccard_at_least(*held, percent) else []
            else:
                pairs = joined(held, percent, None if comp is None else np.unique(comp[a:b], return_inverse=True)[1])
            left += [a + x for x, _ in pairs]
            right += [a + y for _, y in pairs]
        return [(ids[left], ids[right])] if left else []

    return _by_tile(tiles.join(texts, "id"), work).distinct()


def joined(held: list[np.ndarray], percent: int, group: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs that join all sets of a tile that reach the similarity by pairs; sets of one group are joined already."""
    k = len(held)
    n = np.array([len(s) for s in held])
    every, place = np.concatenate(held), np.r_[0, np.cumsum(n)]
    group = np.arange(k) if group is None else group.copy()
    asked, out, inverted = np.zeros(k, bool), [], None
    slot, mark = (every & U64(SLOTS - 1)).astype(np.int32), np.zeros(SLOTS, np.int8)
    for question in range(k):
        open_ = np.flatnonzero(~asked)
        sizes = np.bincount(group[open_], minlength=k)
        if len(open_) < 2 or sizes.max() == len(open_):
            break
        q = int(open_[sizes[group[open_]].argmin()])
        asked[q] = True
        own = held[q]
        if question < SEARCHED:
            # hits of the low bits are at least the common ones; only sets that may be near are searched
            mark[slot[place[q] : place[q + 1]]] = 1
            common = np.add.reduceat(mark[slot], place[:-1], dtype=np.int64)
            mark[slot[place[q] : place[q + 1]]] = 0
            maybe = np.flatnonzero((100 * common >= percent * (n[q] + n - common)) & (group != group[q]))
            if len(maybe):
                some = every if 2 * len(maybe) > k else np.concatenate([held[i] for i in maybe])
                at = np.searchsorted(own, some)
                at[at == len(own)] = 0
                hit = (own[at] == some).view(np.int8)
                if some is every:
                    common = np.add.reduceat(hit, place[:-1], dtype=np.int64)
                else:
                    common[maybe] = np.add.reduceat(hit, np.cumsum(n[maybe]) - n[maybe], dtype=np.int64)
        else:
            if inverted is None:
                codes = np.unique(every, return_inverse=True)[1]
                order = np.argsort(codes, kind="stable")
                inverted = codes, np.repeat(np.arange(k), n)[order], np.r_[0, np.cumsum(np.bincount(codes))]
            codes, member, bounds = inverted
            mine = codes[place[q] : place[q + 1]]
            count = bounds[mine + 1] - bounds[mine]
            common = np.bincount(member[np.arange(int(count.sum())) + np.repeat(bounds[mine] - np.cumsum(count) + count, count)], minlength=k)
        near = np.flatnonzero((100 * common >= percent * (n[q] + n - common)) & (group != group[q]))
        if len(near):
            groups, first = np.unique(group[near], return_index=True)
            out += [(q, x) for x in near[first].tolist()]
            group[np.isin(group, groups)] = group[q]
    return out


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, root): the smallest id reachable over edges (a, b); ids without an edge are not in it.

    Alternating star contraction: each round links every node to the smallest of its neighbourhood, first among its larger
    neighbours, then among its smaller ones, until nothing changes.  A node's neighbourhood is only ever aggregated to its
    minimum and joined back, so a star with many leaves is split like any skewed join; no list of neighbours is gathered.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    # a set of edges is told from another one by its size and two 64-bit sums without carries
    state = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
    last = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("x"), "u", "m")
        small = small.select(F.explode(F.array(F.struct("x", "m"), F.struct(F.col("u").alias("x"), "m"))).alias("e")).select(F.col("e.x").alias("u"), F.col("e.m").alias("v"))
        after = written(small.where("u <> v").distinct(), name)
        now = state(after)
        discard(edges)
        edges, same, last = after, now == last, now
        if same:
            break
    roots = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return written(roots.unionByName(roots.select(F.col("root").alias("id"), "root")).distinct(), name)


def resolve(live: DataFrame, feature: DataFrame, search: Search, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All components over the links of the buckets: (id, root) for ids with a link.

    Every bucket is searched twice: first a few pairs for each member, which join nearly all of a group of near copies; then,
    exhaustively, all pairs that are still in different components.  So no link between components is missed and no group
    emits all its pairs.
    """
    large = _any_large(live)
    pairs = written(_pairs(_first_tiles(live, large), feature, search, True), "pairs")
    links = written(verify(pairs), "links")
    comps = components(links)
    more = written(_pairs(_second_tiles(live, comps, large), feature, search, False).join(pairs, ["a", "b"], "left_anti"), "pairs")
    if not more.limit(1).count():
        return comps
    more = written(verify(more), "links")
    return components(links.unionByName(more)) if more.limit(1).count() else comps


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets, sorted blobs of (id, blob), reach the Jaccard similarity."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(batch.schema.get_field_index("sa")), batch.column(batch.schema.get_field_index("sb"))
            keep = [jaccard_at_least(np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64), percent) for x, y in zip(left, right, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # sets come partitioned by id from their own deduplication; only pairs and the left sets move
    one = pairs.join(sets.select(F.col("id").alias("a"), F.col("blob").alias("sa")), "a")
    two = one.join(sets.select(F.col("id").alias("b"), F.col("blob").alias("sb")), "b")
    return two.select("a", "b", "sa", "sb").mapInArrow(lean(check), "a long, b long")
