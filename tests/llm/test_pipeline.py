import collections

import corpus_pipeline
import duckdb
from granary.llm import packing
from granary.llm._core import read_table

from .test_line_dedup import brute as brute_lines
from .test_line_dedup import norm
from .test_ngram_join import brute as brute_join

PATH = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_stages_against_brute_force(spark):
    docs = read_table(spark, PATH, "documents")
    columns = docs.columns
    state, states = docs, []
    for name, stage in corpus_pipeline.STAGES:
        state = stage(spark, state, PATH)
        if name != "best_fit_packing":
            assert state.columns == columns
        state = spark.createDataFrame(state.collect(), state.schema)
        states.append(rows(state))
    first = {r[0]: r for r in rows(docs)}
    good, lined, single, mixed, packed = states

    labels = dict(duckdb.sql(f"select doc_id, quality from '{PATH}/labels.parquet'").fetchall())
    kept = {r[0] for r in good}
    assert all(r == first[r[0]] for r in good)
    agree = [(q == 1) == (d in kept) for d, q in labels.items() if d in first]
    assert sum(agree) / len(agree) > 0.95

    _, group, _ = brute_lines([(r[0], r[1]) for r in good])
    held = collections.defaultdict(list)
    for r in lined:
        assert r[4] == len(r[1])
        for x in r[1].split("\n"):
            if norm(x):
                held[group[norm(x)]].append((r[0], x))
    assert set(held) == set(group.values())
    assert sum(len(v) - 1 for v in held.values()) <= 0.01 * len(held)

    want = {c for _, n, c in brute_join([(r[0], r[1]) for r in lined]) if n}
    assert {r[0] for r in single} == want | {r[0] for r in lined if not r[1].split()}
    assert len(single) == len({r[0] for r in single})

    assert {r[0] for r in mixed} == {r[0] for r in single} and set(mixed) == set(single)

    tokens = collections.Counter()
    bins = collections.defaultdict(list)
    for d, source, cluster, _, _, n, b, _ in packed:
        tokens[d] += n
        if b is not None:
            bins[b].append((n, source, cluster))
    assert tokens == collections.Counter({d: sum(len(r[1].split()) for r in mixed if r[0] == d) for d in {r[0] for r in mixed}}) + collections.Counter()
    for b in bins.values():
        assert sum(n for n, *_ in b) <= packing.CAPACITY and len({c for *_, c in b}) == len(b)


def test_run_is_registered_and_complete(spark):
    from granary.llm import registry

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "temperature_mixing", "best_fit_packing"]
    out = registry.queries()["pipeline"](spark, PATH)
    assert out.count() > 100 and "bin_id" in out.columns


def test_near_copies_keep_rows_without_an_id(spark):
    from granary.llm.ngram_join import one_of_each

    text = "one two three four five six seven"
    df = spark.createDataFrame([(2, text), (1, text), (1, text), (None, text), (5, ""), (6, None), (6, None)], "doc_id long, text string")
    assert sorted(map(str, rows(one_of_each(df)))) == sorted(map(str, [(1, text), (None, text), (5, ""), (6, None)]))
