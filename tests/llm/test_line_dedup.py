import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from granary.llm import _links
from granary.llm import line_dedup as ld

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("id", T.StringType()), T.StructField("row", T.StringType())])
WHITE = " \t\n\r\x0b\x0c"


def norm(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def shingles(x):
    return {x[i : i + 8] for i in range(max(1, len(x) - 7))}


def brute(rows, percent=75):
    """Text, lines and lost lines of each document, by comparing all pairs that share a shingle."""
    places = sorted({(-(1 << 63) if d is None else d, t, j, norm(x)) for d, t in rows if t is not None for j, x in enumerate(t.split("\n")) if norm(x)}, key=lambda p: p[:1])
    classes = sorted({p[3] for p in places})
    sets = [shingles(c) for c in classes]
    up = list(range(len(classes)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    near = []
    for i, s in enumerate(sets):
        seen = {}
        for g in s:
            for j in holders[g]:
                if j > i:
                    seen[j] = seen.get(j, 0) + 1
        for j, common in seen.items():
            union = len(s) + len(sets[j]) - common
            if 100 * common >= percent * union:
                up[find(i)] = find(j)
            if 100 * common >= 60 * union:
                near.append((i, j, common / union))
    group = {c: find(i) for i, c in enumerate(classes)}
    return places, group, near


def check(spark, rows):
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA).repartition(3)
    out = ld.line_dedup(df).collect()
    assert len(out) == len(rows)
    places, group, _ = brute(rows)
    kept = {}
    for r in out:
        for x in (r.text or "").split("\n"):
            if norm(x):
                kept.setdefault(group[norm(x)], set()).add((r.doc_id, x))
    assert set(kept) == {group[p[3]] for p in places}  # one line of each component stays
    assert all(len(v) == 1 for v in kept.values())
    first = {}
    for d, _, _, x in places:
        first.setdefault(group[x], d)
    assert {g: -(1 << 63) if (d := min(v, key=str)[0]) is None else d for g, v in kept.items()} == first
    return out


def test_edges(spark):
    long = "the quick brown fox jumps over the lazy dog and then it sleeps in the warm afternoon sun for hours"
    rows = [(4, long + "\nshort\n\n  \nunique four"), (2, long.upper() + " \r\nalone"), (7, long.replace("warm", "cold")), (None, None), (9, ""), (8, "\n\n"), (5, "é\né ß\nSHORT"), (6, "x" * 200_000 + "\ny"), (11, "no copy at all\nhere"), (11, "no copy at all\nhere")]
    out = {(r.doc_id, i): r for i, r in enumerate(ld.line_dedup(spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)).collect())}
    by = {r.doc_id: r for r in out.values()}
    assert by[2].text == long.upper() + " \r\nalone"
    assert by[4].text == "short\n\n  \nunique four" and by[4].n_dropped == 1
    assert by[7].text == "" and by[None].text is None and by[9].text == "" and by[8].text == "\n\n"
    assert by[5].text == "é\né ß" and by[6].text == "x" * 200_000 + "\ny"
    assert sum(r.text == "no copy at all\nhere" for r in out.values()) == 2
    assert by[4].row == "y"


def test_groups_of_near_copies_against_brute_force(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    rows, n = [], 0
    for _ in range(3):
        base = [rng.choice(words) for _ in range(45)]
        for _ in range(80):
            line = list(base)
            line[rng.randrange(45)] = rng.choice(words)
            rows.append(((n := n + 1), " ".join(line) + "\n" + " ".join(rng.choice(words) for _ in range(20))))
    rows += [(1000 + i, "the same line everywhere\n" + " ".join(rng.choice(words) for _ in range(12))) for i in range(60)]
    check(spark, rows)


@pytest.mark.parametrize("block,split", [(10, 1 << 16), (1024, 64)])
def test_hot_bands_and_large_buckets(spark, monkeypatch, block, split):
    """A third of all lines in one group of near copies, in buckets of many blocks and band keys of many ranges."""
    monkeypatch.setattr(_links, "BLOCK", block)
    monkeypatch.setattr(_links, "REPRESENTATIVES", 3)
    monkeypatch.setattr(_links, "SPLIT", split)
    monkeypatch.setattr(ld, "ASKED", 4)
    rng = random.Random(block)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    base = [rng.choice(words) for _ in range(45)]
    other = [rng.choice(words) for _ in range(45)]
    rows = []
    for i in range(240):
        line = list(base if i % 4 else other)
        line[rng.randrange(45)] = rng.choice(words)
        rows.append((i, " ".join(line) + "\n" + " ".join(rng.choice(words) for _ in range(20))))
    check(spark, rows)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1), min_size=2, max_size=14), st.booleans(), st.integers(0, 3))
def test_joined_members_are_the_components(sets, grouped, searched):
    """Questions, answered by search or by the inverted list, against comparing all pairs."""
    comp = np.array([i % 3 for i in range(len(sets))]) if grouped else None

    def roots(pairs):
        up = list(range(len(sets)))

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs + ([(i, i % 3) for i in range(len(sets))] if grouped else []):
            up[find(a)] = find(b)
        out = [find(i) for i in range(len(sets))]
        return [out.index(x) for x in out]

    before, _links.SEARCHED = _links.SEARCHED, searched
    try:
        got = _links.joined([np.array(sorted(s), np.uint64) for s in sets], 75, comp)
    finally:
        _links.SEARCHED = before
    every = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    assert roots(got) == roots(every) and {(max(p), min(p)) for p in got} <= set(every)


def test_query_recall_and_precision(spark):
    path = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"select doc_id, text from '{path}/documents.parquet'").fetchall()
    _, group, _ = brute(rows)
    kept = {}
    for r in ld.query(spark, path).collect():
        for x in (r.text or "").split("\n"):
            if norm(x):
                kept.setdefault(group[norm(x)], []).append(x)
    assert set(kept) == set(group.values())  # nothing but copies goes
    assert sum(len(v) - 1 for v in kept.values()) <= 0.005 * len(kept)  # hardly a copy stays


def test_signatures_estimate_similarity():
    rng = random.Random(11)
    a = "".join(rng.choice("abcdefgh ") for _ in range(2000))
    b = a[:1000] + "".join(rng.choice("abcdefgh ") for _ in range(200)) + a[1200:]
    data = (a + "\n" + b).encode()
    found = ld.Lines(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    s = ld.signatures(*found.shingles(found.start, found.end))
    x, y = shingles(a.strip()), shingles(b.strip())
    assert abs((s[0] == s[1]).mean() - len(x & y) / len(x | y)) < 0.15


def test_bands_miss_few_pairs_at_the_threshold():
    pairs, common, own = 20_000, 84, 14  # Jaccard 84 / 112 = 0.75; 16 bands miss 0.23% of such pairs, 14 miss 0.49%
    x = np.random.default_rng(5).integers(0, 1 << 32, (pairs, common + 2 * own), np.uint32)
    sets = np.concatenate([x[:, : common + own], np.c_[x[:, :common], x[:, common + own :]]])
    first = np.arange(len(sets)) * (common + own)
    keys = ld.band_keys(ld.signatures(sets.ravel(), first, first + common + own))
    assert (~(keys[:pairs] == keys[pairs:]).any(1)).sum() <= 60


def test_line_lengths_from_which_an_edit_is_found():
    def similar(n, edit):
        line = "".join(map(chr, range(0x4E00, 0x4E00 + n)))
        other = line[: n // 2] + "x" * edit + line[n // 2 + edit :]
        x, y = (set(s.tolist()) for s in ld.line_sets([line.encode(), other.encode()]))
        return 100 * len(x & y) >= ld.PERCENT * len(x | y)

    for edit, least in ((1, 63), (5, 91)):  # the README names these lengths
        assert similar(least, edit) and not similar(least - 1, edit)


def test_empty_table(spark):
    assert ld.line_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
