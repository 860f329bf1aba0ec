import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm import mixing

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("block", T.StringType()), T.StructField("tokens", T.LongType())])


def brute_exponent(tokens, entropy, repeats):
    p = np.array(tokens) / sum(tokens)

    def h(a):
        w = p**a / (p**a).sum()
        return -(w * np.log(w)).sum()

    low, high = 0.0, 1.0
    if h(1.0) >= entropy * math.log(len(p)):
        low = 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if h(mid) >= entropy * math.log(len(p)) else (low, mid)
    spread = p.max() / p.min()
    return max(low, 1 - math.log(repeats) / math.log(spread) if spread > repeats else 0.0)


@pytest.mark.parametrize("tokens", [[900, 50, 50], [5, 5, 5], [1000, 10, 200, 40], [700, 690]])
@pytest.mark.parametrize("limits", [(0.97, 2.0), (0.8, 100.0), (0.99, 1000.0)])
def test_exponent(spark, tokens, limits):
    df = spark.createDataFrame([(t,) for t in tokens], "tokens long")
    got = mixing.exponent(df, *limits)
    assert got == pytest.approx(brute_exponent(tokens, *limits), abs=1e-5)


def table(spark):
    rng = np.random.default_rng(4)
    rows = []
    for source, n in (("a", 600), ("b", 60), (None, 30), ("c", 90)):
        rows += [(len(rows) + i, " w" * int(rng.integers(1, 40)), source, "B", 7) for i in range(n)]
    rows += [(9000, None, "a", "B", 7), (9001, "", "b", "B", 7), (None, "x y", "c", "B", 7), (9002, "same", "c", "B", 7), (9002, "same", "c", "B", 7)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("budget", [None, 6000, 40000])
def test_budget_and_permutation(spark, budget):
    rows, df = table(spark)
    out = mixing.mix(df, budget=budget, block_tokens=300).collect()
    tokens = {s: sum(len((r[1] or "").split()) for r in rows if r[2] == s) for s in {r[2] for r in rows}}
    a = brute_exponent(list(tokens.values()), 0.97, 2.0)
    q = {s: (t / sum(tokens.values())) ** a for s, t in tokens.items()}
    scale = budget / sum(q.values()) if budget else max(t / q[s] for s, t in tokens.items())
    given = collections.Counter()
    for r in out:
        assert r.mix_tokens == len((r.text or "").split()) and r.block == "B" and r.tokens == 7
        given[r.source] += r.mix_tokens
    for s, t in tokens.items():
        target = scale * q[s]
        assert target - 80 <= given[s] <= target * 1.0001 + 1, (s, given[s], target)  # short of it by less than two rows
        copies = collections.Counter((r.doc_id, r.text) for r in out if r.source == s)
        owned = collections.Counter((r[0], r[1]) for r in rows if r[2] == s)
        low, high = math.floor(target / t - 1e-4), math.floor(target / t + 1e-4) + 1
        assert all(low * n <= copies[k] <= high * n for k, n in owned.items())
    if budget is None:
        assert {(r[0], r[1]) for r in rows} == {(r.doc_id, r.text) for r in out}


def brute_mix(spark, rows, budget, block_tokens, block_rows):
    """(doc_id, text, pass) by walking each source's blocks in the order of their hashes; only the hashes are Spark's."""

    def hashes(values, schema, *columns):
        return [r[0] for r in spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i long, " + schema).orderBy("i").select(F.xxhash64(F.lit(mixing.SEED), *columns)).collect()]

    keys = hashes([(r[0], r[1]) for r in rows], "doc_id long, text string", "doc_id", "text")
    size = [len((r[1] or "").split()) for r in rows]
    own = {s: [i for i, r in enumerate(rows) if r[2] == s] for s in {r[2] for r in rows}}
    tokens = {s: sum(size[i] for i in at) for s, at in own.items()}
    a = brute_exponent(list(tokens.values()), mixing.ENTROPY, mixing.REPEATS)
    q = {s: (t / sum(tokens.values())) ** a for s, t in tokens.items()}
    out = []
    for s, at in own.items():
        blocks = max(1, -(-tokens[s] // block_tokens), -(-len(at) // block_rows))
        block = [h % blocks for h in hashes([(s, keys[i]) for i in at], "s string, k long", F.lit("deal"), "s", "k")]
        target = int(budget * q[s] / sum(q.values()) * (1 + 1e-12))
        full, rest = divmod(target, tokens[s])
        out += [(*rows[i][:2], p) for i in at for p in range(full)]
        if not rest:
            continue
        order = hashes([(full, s, b) for b in range(blocks)], "p long, s string, b long", "p", "s", "b")
        for b in sorted(range(blocks), key=lambda b: (order[b], b)):
            held = [i for i, x in zip(at, block, strict=True) if x == b]
            if not held:
                continue
            total = sum(size[i] for i in held)
            if total <= rest:
                out += [(*rows[i][:2], full) for i in held]
                rest -= total
                if not rest:
                    break
                continue
            place = dict(zip(held, hashes([(full, keys[i]) for i in held], "p long, k long", "p", "k"), strict=True))
            for k in sorted({(place[i], keys[i]) for i in held}):
                alike = [i for i in held if keys[i] == k[1]]
                rest -= sum(size[i] for i in alike)
                if rest < 0:
                    break
                out += [(*rows[i][:2], full) for i in alike]
            break
    return out


@pytest.mark.parametrize("budget", [900, 6000, 9111, 40000])
@pytest.mark.parametrize("blocks", [(300, 10_000), (5000, 25)])
def test_against_brute_force(spark, monkeypatch, budget, blocks):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", blocks[1])
    rows, df = table(spark)
    got = collections.Counter((r.doc_id, r.text, r.mix_pass) for r in mixing.mix(df, budget=budget, block_tokens=blocks[0]).collect())
    assert got == collections.Counter(brute_mix(spark, rows, budget, *blocks))


def test_passes_are_different_permutations(spark):
    _, df = table(spark)
    out = mixing.mix(df, budget=40000, block_tokens=300).collect()
    orders = [[r.doc_id for r in sorted((r for r in out if r.source == "a" and r.mix_pass == p), key=lambda r: r.mix_order)] for p in (0, 1)]
    assert len(orders[1]) > 100 and orders[0][: len(orders[1])] != orders[1]
    assert max(collections.Counter((r.doc_id, r.mix_pass) for r in out if r.doc_id not in (None, 9002)).values()) == 1


def test_same_result_however_dealt(spark):
    _, df = table(spark)
    one, two = (sorted(map(str, mixing.mix(d, budget=9000, block_tokens=500).collect())) for d in (df, df.repartition(7, "text")))
    assert one == two


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(empty).collect() == []
    assert len(mixing.mix(spark.createDataFrame([(1, None, "a", "", 0), (2, "", None, "", 0)], SCHEMA)).collect()) == 2
    counted = spark.createDataFrame([(" a\tb\n\nc ",), ("",), (None,), ("\x0b\x0c ",), ("é",)], "text string").select(mixing.token_count())
    assert [r[0] for r in counted.collect()] == [3, 0, 0, 0, 1]


def test_query(spark):
    path = "/root/testdata/sf0.001"
    out = mixing.query(spark, path)
    assert out.select("doc_id").distinct().count() == 200
    assert out.groupBy("source").agg(F.max("mix_pass")).agg(F.max("max(mix_pass)")).first()[0] <= 1
