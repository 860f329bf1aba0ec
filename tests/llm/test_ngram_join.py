import itertools
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import types as T

from granary.llm import _links, ngram_join
from granary.llm._core import read_table

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n", T.StringType()), T.StructField("id", T.StringType())])


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    for i, j in {p for h in holders.values() for p in itertools.combinations(h, 2)}:
        if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def run(spark, rows):
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in ngram_join.ngram_jaccard_join(df).collect()), key=str)


def test_edges_of_the_contract(spark):
    base = "Ab c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(5, base), (3, base.upper()), (9, base + " extra"), (1, None), (2, ""), (4, " \t\n"), (6, "one two"), (7, "One  two"), (8, "é ß"), (10, base), (10, base), (None, base), (None, None), (11, "long " * 30000), (12, "long " * 29000)]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_large_groups_of_near_copies(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows, n = [], 0
    for _group in range(3):
        base = [rng.choice(vocabulary) for _ in range(120)]
        for _ in range(90):
            copy = list(base)
            for _ in range(rng.randrange(7)):
                copy[rng.randrange(120)] = rng.choice(vocabulary)
            rows.append((n := n + 1, " ".join(copy)))
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows += [((n := n + 1), " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 60))) + " " + passage) for _ in range(150)]
    assert run(spark, rows) == brute(rows)


def test_query_against_brute_force(spark):
    path = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"select doc_id, text from '{path}/documents.parquet'").fetchall()
    got = sorted((tuple(r) for r in ngram_join.query(spark, path).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("leaf", [2, 16])
def test_tree_keeps_every_pair_that_could_link(seed, leaf):
    """Tiles of 1 to 300 points in one tree, with and without groups."""
    rng = np.random.default_rng(seed)
    points = rng.poisson(2, (400, ngram_join.GROUPS)).astype(np.uint8)
    points[200:] = points[:200] + (rng.random((200, ngram_join.GROUPS)) < 0.1)
    points = points[rng.permutation(400)]
    sizes = points.sum(1).astype(np.int64)
    tile = np.repeat(np.arange(5), [1, 2, 300, 17, 80])
    for group in (None, rng.integers(0, 3, 400)):
        tree = ngram_join.CountRTree(points, sizes, tile, group, leaf)
        assert len(tree.levels) >= 3 and len(tree.roots) == 5
        for _, _, _, _, _, _, children in tree.levels:
            assert np.diff(children).max() <= leaf
        left, right, bound = tree.pairs(75, chunk=500)
        want = set()
        for i in range(400):
            for j in range(i + 1, 400):
                total = int(np.minimum(points[i], points[j]).sum())
                near = 100 * min(sizes[i], sizes[j]) >= 75 * max(sizes[i], sizes[j]) and total * 175 >= 75 * (sizes[i] + sizes[j])
                if tile[i] == tile[j] and near and (group is None or group[i] != group[j]):
                    want.add((i, j, total))
        assert {(min(a, b), max(a, b), n) for a, b, n in zip(left.tolist(), right.tolist(), bound.tolist(), strict=True)} >= want
        extra = {(min(a, b), max(a, b), n) for a, b, n in zip(left.tolist(), right.tolist(), bound.tolist(), strict=True)} - want
        assert all(n * 175 >= 75 * (sizes[i] + 0.75 * sizes[i]) - 175 for i, j, n in extra)


def test_both_searches_go_through_the_tree(monkeypatch):
    made = []
    real = ngram_join.CountRTree
    monkeypatch.setattr(ngram_join, "CountRTree", lambda *a: made.append(len(a[0])) or real(*a))
    sets = [np.arange(i, i + 40, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for i in (0, 1, 2, 500, 501)]
    feats, n, tile = ngram_join.count_points(sets), np.full(5, 40), np.array([0, 0, 0, 1, 1])
    search = ngram_join.searcher(75)
    left, right = search(n, feats, tile, None)
    assert {frozenset(p) for p in zip(left.tolist(), right.tolist(), strict=True)} >= {frozenset((3, 4))} and len(left) == 3
    left, right = search(n, feats, tile, np.array([0, 0, 1, 2, 2]))
    assert {frozenset(p) for p in zip(left.tolist(), right.tolist(), strict=True)} == {frozenset((0, 2)), frozenset((1, 2))}
    assert made == [5, 5]


@pytest.mark.parametrize("block,split", [(16, 1 << 16), (1024, 8), (12, 8)])
def test_hot_keys_and_large_buckets(spark, monkeypatch, block, split):
    """Groups of near copies, chains and outsiders that share passages, with buckets of many blocks and keys of many ranges."""
    monkeypatch.setattr(_links, "BLOCK", block)
    monkeypatch.setattr(_links, "REPRESENTATIVES", 3)
    monkeypatch.setattr(_links, "SPLIT", split)
    rng = random.Random(block + split)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, n = [], 0
    for size in (150, 60, 5):
        base = [rng.choice(vocabulary) for _ in range(90)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(9)):
                copy[rng.randrange(90)] = rng.choice(vocabulary)
            rows.append((n := n + 1, " ".join(copy)))
    walk = [rng.choice(vocabulary) for _ in range(60)]
    for i in range(120):  # a chain: neighbours link, ends don't
        walk[i % 60] = rng.choice(vocabulary)
        rows.append((n := n + 1, " ".join(walk)))
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows += [((n := n + 1), " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(2, 40))) + " " + passage) for _ in range(150)]
    assert run(spark, rows) == brute(rows)


def test_table_is_read_by_spark(spark):
    assert read_table(spark, "/root/testdata/sf0.001", "documents").count() == 200


def test_one_of_each_tells_texts_of_a_doc_id_apart(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    rows = [(1, a), (5, a + " more"), (5, b), (9, b + " more"), (5, c), (5, c), (7, c + " more")]
    got = [(r.doc_id, r.text) for r in ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert sorted(got) == sorted([(1, a), (5, b), (5, c)])


def test_one_of_each_keeps_one_of_two_near_texts_of_a_doc_id(spark):
    a = " ".join(f"a{i}" for i in range(40))
    rows = [(5, a), (5, a + " more"), (6, a + " most")]
    got = [(r.doc_id, r.text) for r in ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == 1 and got[0][0] == 5
