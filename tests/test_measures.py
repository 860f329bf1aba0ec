"""Measures against plain loops, with ties, large values, nulls and empty tables."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from granary.operators import measures as M


def near(x):
    return pytest.approx(x, abs=1e-9)


def test_softmax_and_nucleus(spark):
    rows = [(k, i, x) for k, xs in enumerate([[1000.0, 999.0, 0.0], [5.0], [2.0, 2.0, 2.0, 2.0], [-800.0, -801.0]]) for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "k long, i long, x double")
    p = {(r.k, r.i): r.p for r in M.softmax(df, "k", F.col("x")).collect()}
    assert p[0, 0] == near(1 / (1 + math.exp(-1))) and p[1, 0] == 1.0 and p[2, 3] == 0.25 and p[3, 1] == near(1 / (1 + math.e))
    assert {(r.k, r.i) for r in M.nucleus(df, "k", "i", F.col("x"), 0.5).collect()} == {(0, 0), (1, 0), (2, 0), (2, 1), (3, 0)}
    assert M.nucleus(df.where("false"), "k", "i", F.col("x"), 0.5).count() == 0


def test_ranks_and_losses(spark):
    rng = random.Random(3)
    rows = [(k, i, float(rng.randrange(6))) for k in range(40) for i in range(rng.randrange(1, 8))] + [(99, 1, 3.0)]  # 99 has no positive
    df = spark.createDataFrame(rows, "k long, i long, x double")
    groups = collections.defaultdict(dict)
    for k, i, x in rows:
        groups[k][i] = x
    have = [g for g in groups.values() if 0 in g]
    rank = [1 + sum(x > g[0] for x in g.values()) for g in have]
    nll = [math.log(sum(map(math.exp, g.values()))) - g[0] for g in have]
    mean = lambda v: near(sum(v) / len(v))
    got = M.retrieval(df, "k", "x", F.col("i") == 0).first()
    assert (got.acc1, got.mrr) == (mean([r == 1 for r in rank]), mean([1 / r for r in rank]))
    assert M.info_nce(df, "k", F.col("x"), F.col("i") == 0).first().loss == mean(nll)
    got = M.recall_metrics(df.where("k <> 99"), "k", F.col("x"), F.col("i") == 0).first()
    margins = [g[0] - max(x for i, x in g.items() if i) for g in have if len(g) > 1]
    assert (got.mean_rank, got.nll, got.margin) == (mean(rank), mean(nll), mean(margins))
    top = {r.i: r.top2 for r in M.top_k_accuracy(df, "k", "x", "i", "i", 2).collect()}
    first = collections.defaultdict(list)
    for g in groups.values():
        order = sorted(g, key=lambda i: (-g[i], i))
        for i in g:
            first[i].append(order.index(i) < 2)
    assert top == {i: mean(v) for i, v in first.items()}
    best = M.choice_accuracy(df, "k", "i", F.lit(1), a=F.col("x"), b=-F.col("x")).first()
    assert best.a == mean([min(g, key=lambda i: (-g[i], i)) == 1 for g in groups.values()]) and best.b == mean([min(g, key=lambda i: (g[i], i)) == 1 for g in groups.values()])


def test_curves_of_classes(spark):
    rng = random.Random(8)
    rows = [(None if c == 3 else c, rng.randrange(20) / 4, i, 0, c != 2 and rng.random() < 0.4) for i in range(300) for c in [rng.randrange(4)]]
    df = spark.createDataFrame(rows, "c long, x double, i long, j long, hit boolean")
    f1 = {r.c: r.f1 for r in M.class_best_f1(df, "c", "x", ("i", "j"), F.col("hit")).collect()}
    ap = {r.c: r.ap for r in M.class_precision(df.where("c is not null"), "c", "x", ("i", "j"), F.col("hit")).collect()}
    assert set(f1) == {0, 1, 2, None} and set(ap) == {0, 1, 2}
    for c in f1:
        order = [r[4] for r in sorted((r for r in rows if r[0] == c), key=lambda r: (-r[1], r[2]))]
        total, tp, points = sum(order), 0, []
        for n, hit in enumerate(order, 1):
            tp += hit
            points.append((tp / n, 2 * tp / (n + total), hit))
        assert f1[c] == near(max(p[1] for p in points))
        if c is not None:
            area = sum(max(q[0] for q in points[i:]) for i, p in enumerate(points) if p[2])
            assert ap[c] == near(area / total if total else 0.0)


def test_banned_tokens_for_any_length(spark):
    rng = random.Random(4)
    rows = [(k, i, rng.choice("ab") if rng.random() < 0.95 else None) for k in range(30) for i in range(rng.randrange(1, 25))]
    df = spark.createDataFrame(rows, "k long, i long, t string")
    for n in (1, 2, 3):
        want = set()
        for k in range(30):
            t = [x for key, _, x in rows if key == k]
            last = t[-n:] if len(t) >= n else None
            want |= {(k, t[i + n]) for i in range(len(t) - n) if t[i : i + n] == last and None not in last and t[i + n] is not None}
        assert {tuple(r) for r in M.banned_next(df, "k", ["i"], "t", n).collect()} == want


def test_shares_and_mixtures(spark):
    df = spark.createDataFrame([("a", i % 4, 10) for i in range(16)] + [("b", 0, 30)] * 4, "g string, e long, n long")
    assert {r.g: r.entropy for r in M.routing_entropy(df, "g", "e", 4).collect()} == {"a": near(1.0), "b": near(0.0)}
    assert {r.g: r.weight for r in M.power_mixture(df, "g", 0.5).collect()} == {"a": near(4 / 6), "b": near(2 / 6)}
    assert {r.g: r.weight for r in M.loss_weights(df, "g", "n").collect()} == {"a": near(0.5 / (160 / 280)), "b": near(0.5 / (120 / 280))}
    groups = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("c", 2.0), ("c", 2.0)], "g string, v double")
    assert sorted(r.advantage for r in M.group_advantage(groups, "g", "v").collect()) == [pytest.approx(-1 / 2**0.5), pytest.approx(1 / 2**0.5)]
    none = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "g string, e long")
    assert {(r.g, r.e): r.share for r in M.shares(none, "g", "e").collect()} == {(None, 1): 0.5, (None, 2): 0.5, ("a", 1): 1.0}


def test_profiles_and_previous_rows(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "a", "b", None]), i, float(rng.randrange(9)), rng.choice(["x", " X ", "y", None])) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, i long, v double, t string").repartition(5)
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    got = {r.g: r for r in M.profile(df, "g", "v", "i", low=0.0, mid=0.5, high=0.99).collect()}
    assert set(got) == set(groups)
    for g, members in groups.items():
        order = sorted(r[2] for r in members)
        assert (got[g].low, got[g].mid, got[g].high) == (order[0], order[len(order) // 2], order[int(len(order) * 0.99)])
    before = {r.i: r.before for r in M.following(df, "g", "i", value="t").collect()}
    want = {b[1]: a[3] if a else None for members in groups.values() for a, b in zip([None, *members], members, strict=False)}
    assert before == want
    clean = lambda x: (x or "").strip().lower()
    rates = {r.g: r.rate for r in M.exact_match(M.following(df, "g", "i", value="t"), "g", "t", "before").collect()}
    assert rates == {g: near(sum(clean(r[3]) == clean(want[r[1]]) for r in m) / len(m)) for g, m in groups.items()}
    assert M.profile(df.where("false"), "g", "v", "i", mid=0.5).count() == 0


def test_blank_surfaces_pass_the_cap(spark):
    from granary.operators import relational

    rows = [("t", i, ["s", "", None][i % 3]) for i in range(60)]
    got = relational.surface_cap(spark.createDataFrame(rows, "task string, k long, surface string"), "task", "k", "surface", 4).collect()
    assert collections.Counter(r.surface for r in got) == {"s": 4, "": 20, None: 20}
