"""What queries without a SQL twin must give, by plain Python; only the hashes that place rows are Spark's."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from granary import catalog
from granary.operators import corpus, ordering, series
from granary.records import with_retry

PATH = "/root/testdata/sf0.001"
QUERIES = catalog.queries()


def run(spark, name):
    return QUERIES[name](spark, PATH).collect()


def table(spark, name):
    return spark.read.parquet(f"{PATH}/{name}.parquet")


def hashes(spark, schema, rows, *columns):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, " + schema)
    return [r[0] for r in df.orderBy("i").select(F.xxhash64(*columns)).collect()]


def test_shuffles_are_orders_of_all_rows(spark):
    ids = [r.doc_id for r in table(spark, "documents").select("doc_id").collect()]
    want = dict(zip(ids, hashes(spark, "d long", [(i,) for i in ids], F.lit(42), "d"), strict=True))
    assert [r.doc_id for r in run(spark, "srt01_shuffle")] == sorted(ids, key=want.get)
    items = [r.item_id for r in table(spark, "benchmark").select("item_id").collect()]
    epochs = collections.defaultdict(dict)
    for r in run(spark, "srt07_epoch_order"):
        epochs[r.epoch][r.item_id] = r.place
    assert set(epochs) == {0, 1, 2} and all(set(e) == set(items) for e in epochs.values())
    orders = [tuple(sorted(e, key=e.get)) for e in epochs.values()]
    assert len(set(orders)) == 3


def test_draws_with_replacement(spark):
    ids = sorted(r.doc_id for r in table(spark, "documents").select("doc_id").collect())
    picks = hashes(spark, "x long", [(i,) for i in range(500)], F.lit(3), "x")
    want = collections.Counter(ids[p % len(ids)] for p in picks)
    assert {r.doc_id: r.draws for r in run(spark, "srt06_with_replacement")} == want


def test_interleaving_follows_the_weights(spark):
    docs = {r.doc_id: r.source for r in table(spark, "documents").select("doc_id", "source").collect()}
    assert {r.doc_id for r in run(spark, "mix06_interleave")} == set(docs)
    weights = {r.source: r.weight for r in corpus._weights(spark, PATH).collect()}
    place = {r.doc_id: r.place for r in run(spark, "mix05_weighted_interleave")}
    assert set(place) == set(docs) and abs(sum(weights.values()) - 1) < 1e-9
    mean = {s: [p * weights[s] for d, p in place.items() if docs[d] == s] for s in weights}
    every = [x for v in mean.values() for x in v]
    assert 0.75 < sum(every) / len(every) < 1.25  # waiting times of a source are exponential with its weight as rate


def test_dropped_tokens_and_modalities(spark):
    sizes = {r.item_id: len(r.text.lower().split()) for r in table(spark, "benchmark").collect()}
    got = {r.item_id: r.n for r in run(spark, "arr04_token_drop")}
    assert set(got) == set(sizes) and all(0 < got[i] for i in got)
    assert 0.7 < sum(got.values()) / sum(sizes.values()) < 0.95
    has = collections.defaultdict(set)
    for r in table(spark, "events").select("user_id", "event_type").distinct().collect():
        has[r.user_id].add(r.event_type)
    kept = {r.user_id: r.kept for r in run(spark, "flt16_modality_dropout")}
    assert set(kept) == set(has) and all(v and set(v) <= has[u] for u, v in kept.items())
    pairs = [(m, u) for u in has for m in sorted(has[u])]
    order = hashes(spark, "m string, u long", pairs, "m", "u")
    drawn = collections.defaultdict(list)
    for (m, u), h in zip(pairs, order, strict=True):
        if h % 10 >= 4:
            drawn[u].append(m)
    assert all(kept[u] == (drawn[u] or sorted(has[u])[:1]) for u in has)


def test_whole_files_and_synthetic_sums(spark):
    assert [tuple(r) for r in run(spark, "src09_whole_texts")] == [(4, True)]
    rows = run(spark, "src31_synthetic")
    assert len(rows) == 1000 and all(r.answer == r.a + r.b and 0 <= r.a < 100 and r.question == f"What is {r.a} + {r.b}?" for r in rows)


def test_hard_negatives(spark):
    rows = table(spark, "embeddings").select("label", "vec_id").collect()
    place = dict(zip([r.vec_id for r in rows], hashes(spark, "v long", [(r.vec_id,) for r in rows], F.lit(1), "v"), strict=True))
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r.label].append(r.vec_id)
    got = {r.vec_id: r.negatives for r in run(spark, "mix12_hard_negatives")}
    for label, members in groups.items():
        few = sorted(members, key=lambda v: (place[v], v))[:4]
        for v in members:
            assert got[v] == [x for x in few if x != v][:3], label


def test_short_lists_of_negatives_are_drawn_with_replacement(spark):
    df = spark.createDataFrame([(1, list("abcdef")), (2, ["x", "y"]), (3, []), (4, None)], "id long, negatives array<string>")
    got = {r.id: r.negatives for r in series.hard_negatives(df, "negatives", 4).collect()}
    assert set(got) == {1, 2} and len(set(got[1])) == 4 and set(got[1]) <= set("abcdef")
    assert len(got[2]) == 4 and set(got[2]) <= {"x", "y"}


def envelope(ids, labels, before, after, eos, length):
    """A second telling of the rule, place by place."""
    on = [i for i, v in enumerate(labels) if v != -100]
    start = on[-1]
    while start - 1 in on:
        start -= 1
    answer = [v for v in labels[start : on[-1] + 1] if v != eos][: max(1, length - len(before) - len(after) - 1)]
    tail = before + answer + after + [eos]
    lead = ids[: start + 1]
    lead = lead[len(lead) - min(len(lead), max(1, length + 1 - len(tail))) :]
    whole = (lead + tail)[: length + 1]
    x, y = whole[:-1], [-100 if i + 1 < len(lead) else v for i, v in enumerate(whole[1:])]
    return x + [eos] * (length - len(x)), y + [-100] * (length - len(y))


def test_envelope_of_the_last_supervised_span(spark):
    rng = random.Random(5)
    cases = []
    for i in range(120):
        n = rng.randrange(1, 30)
        ids = [rng.randrange(1, 50) for _ in range(n)]
        labels = [rng.choice([-100, -100, 0, rng.randrange(1, 50)]) if rng.random() < 0.6 else -100 for _ in range(n)]
        labels[rng.randrange(n)] = 7
        cases.append((i, ids, labels))
    df = spark.createDataFrame(cases, "i long, ids array<long>, labels array<long>")
    for length in (6, 16, 40):
        got = df.select("i", series.reasoning_envelope(F.col("ids"), F.col("labels"), [901, 902], [903], 0, length).alias("e")).collect()
        for r in got:
            _, ids, labels = cases[r.i]
            assert (r.e.ids, r.e.labels) == envelope(ids, labels, [901, 902], [903], 0, length), (ids, labels, length)
    none = spark.createDataFrame([(1, [1], [-100])], "i long, ids array<long>, labels array<long>")
    with pytest.raises(Exception, match="supervised"):
        none.select(series.reasoning_envelope(F.col("ids"), F.col("labels"), [1], [2], 0, 8)).collect()


def test_windows_by_pieces_are_windows_of_tokens(spark):
    """Documents of any length against one list of tokens a source, with and without overlap and tail."""
    rng = random.Random(2)
    docs = [(i, f"s{i % 3}", " ".join(f"t{rng.randrange(99)}" for _ in range(rng.choice([0, 1, 3, 7, 40, 200])))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    for length, overlap, eos in ((8, 0, "<eos>"), (8, 1, "<eos>"), (16, 5, None), (500, 1, None)):
        streams = collections.defaultdict(list)
        for _, s, t in sorted(docs):
            if t:
                streams[s] += t.split() + ([eos] if eos else [])
        for tail in (False, True):
            got = {(r.source, r.window): (r.n, r.text) for r in corpus.windows(corpus.laid_out(df, eos), length, overlap, tail).collect()}
            want = {}
            for s, x in streams.items():
                for w, at in enumerate(range(0, len(x), length)):
                    part = x[at : at + length + overlap]
                    if tail or len(part) == length + overlap:
                        want[s, w] = (len(part), " ".join(part))
            assert got == want, (length, overlap, eos, tail)


def test_numbered_within_few_keys(spark):
    rows = [("a" if i % 5 else None if i % 2 else "b", (i * 37) % 101) for i in range(100)]
    got = ordering.numbered_within(spark.createDataFrame(rows, "k string, v long").repartition(3), ["k"], "v").collect()
    want = {}
    for k in {k for k, _ in rows}:
        want |= {(k, v): i for i, v in enumerate(sorted(v for key, v in rows if key == k))}
    assert {(r.k, r.v): r.position for r in got} == want


def test_retry_waits_and_gives_up():
    waits, calls = [], []

    def fails(times):
        calls.append(1)
        if len(calls) <= times:
            raise OSError("again")
        return "done"

    assert with_retry(lambda: fails(2), 5, waits.append) == "done" and waits == [1, 2]
    calls.clear()
    with pytest.raises(OSError):
        with_retry(lambda: fails(9), 3, waits.append)
    assert len(calls) == 3
