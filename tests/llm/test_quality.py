import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from granary.llm import quality as q

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("x", T.StringType()), T.StructField("label", T.StringType())])
LABELS = "doc_id long, quality int, toxic int"


def test_statistics_do_not_depend_on_neighbours():
    texts = [b"", b"A b c! d\ne f g h a b c! d e", "é|ü 12".encode(), b"one", b" \n ", b"w " * 5000]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    whole = q.statistics(data, offsets)
    assert np.isfinite(whole).all() and whole.shape == (len(texts), len(q.NAMES))
    for i, t in enumerate(texts):
        assert np.allclose(whole[i], q.statistics(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]), t


def test_statistics_by_hand():
    text = "The cat! the DOG\nthe cat!\nx"
    x = dict(zip(q.NAMES, q.statistics(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))[0], strict=True))
    assert np.isclose(x["bytes"], np.log1p(len(text))) and np.isclose(x["words"], np.log(8))
    assert np.isclose(x["new_words"], np.log(5 / 8) / np.log(10))
    assert np.isclose(x["bang"], np.log(2.5 / (len(text) + 1) / (1 - 2.5 / (len(text) + 1))), atol=1e-6)


def plain(text):
    """All statistics of a text by plain loops."""
    data = text.encode()
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in data)
    w = [x for x in re.split(rb"[ \t\n\x0b\x0c\r]+", low) if x]
    lines = [x for i, x in enumerate(low.split(b"\n")) if x or i < low.count(b"\n")]  # a line after the last feed counts if it has bytes
    lines = [x + (b"\n" if i < low.count(b"\n") else b"") for i, x in enumerate(lines)]
    runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n, size = len(data), [len(x) for x in w]
    mean = sum(size) / max(1, len(w))
    spread = math.sqrt(max(0.0, sum(x * x for x in size) / max(1, len(w)) - mean**2))
    count = lambda members: sum(c in members for c in data)
    upper, lower = count(range(65, 91)), count(range(97, 123))

    def logit(part, whole):
        p = (part + 0.5) / (whole + 1)
        return math.log(p / (1 - p + 1e-9))

    symbols = b"!#$%&*|<>{}[]\\^~=+_@/"
    return {
        "bytes": math.log1p(n), "words": math.log1p(len(w)), "word_length": math.log1p(mean), "word_spread": math.log1p(spread), "upper": logit(upper, upper + lower), "digit": logit(count(range(48, 58)), n),
        "white": logit(count(b" \t\n\x0b\x0c\r"), n), "sentence": logit(count(b".,;:?'\""), n), "symbol": logit(count(symbols), n), "bang": logit(count(b"!"), n), "bar": logit(count(b"|"), n), "multi_byte": logit(count(range(128, 256)), n),
        "feeds": logit(count(b"\n"), n), "short_words": logit(sum(x <= 3 for x in size), len(w)), "long_words": logit(sum(x >= 12 for x in size), len(w)), "symbol_ends": logit(sum(x[-1] in symbols for x in w), len(w)),
        "new_words": math.log((len(set(w)) + 1) / (len(w) + 1)) / math.log(len(w) + 3), "new_shingles": logit(len(runs) - len(set(runs)), len(runs)), "new_lines": logit(len(lines) - len(set(lines)), len(lines)),
        "top_word": logit(max(Counter(w).values(), default=0), len(w)),
    }


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["The", "the", "DOG!", "a", " ", "\n", "\t", "é", "x=1", "|", "2024", "internationally", "a b c d e f ", "ü."]), max_size=30).map("".join), min_size=1, max_size=4))
def test_statistics_against_plain_loops(texts):
    raw = [t.encode() for t in texts]
    got = q.statistics(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(t) for t in raw])])
    for t, row in zip(texts, got, strict=True):
        want = plain(t)
        assert list(want) == list(q.NAMES)
        assert np.allclose(row, list(want.values()), atol=1e-6), (t, {k: (a, b) for (k, b), a in zip(want.items(), row, strict=True) if not np.isclose(a, b, atol=1e-6)})


def test_scores_are_the_models(spark):
    """The query's scores against a model fitted in one piece on all rows."""
    path = "/root/testdata/sf0.001"
    docs = duckdb.sql(f"select doc_id, text from '{path}/documents.parquet'").fetchall()
    truth = dict(duckdb.sql(f"select doc_id, quality from '{path}/labels.parquet'").fetchall())
    x = {d: np.array(list(plain(t or "").values())) for d, t in docs}
    fold = {d: zlib.crc32(str(d).encode()) % 5 for d in x}
    rows = {c: np.array([x[d] for d in x if fold[d] and truth.get(d) == c]) for c in (0, 1)}
    model = q.fit({c: q.moments(v) for c, v in rows.items()})
    q.calibrate(model, np.stack([np.bincount(q.bin_of(model.raw(rows[c])), minlength=q.BINS) for c in (0, 1)]).astype(float))
    want = dict(zip(x, model.score(np.array(list(x.values()))), strict=True))
    got = q.query(spark, path).collect()
    assert len(got) == len(docs)
    assert all(abs(r.score - want[r.doc_id]) < 1e-4 and r.predicted == (r.score >= 0.3) and r.held_out == (fold[r.doc_id] == 0) for r in got)


def test_bounded_labels(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 7 + 1), "x", "l") for i in range(400)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)], LABELS)
    every = q.labelled_first(docs, labels).count()
    assert every == q.labelled(q.featured(docs), labels).count()
    monkeypatch.setattr(q, "TRAIN_ROWS", 100)
    assert 60 < q.labelled_first(docs, labels).count() < 140


def test_discriminant_against_the_density():
    rng = np.random.default_rng(0)
    x = {0: rng.normal(1, 2, (800, len(q.NAMES))), 1: rng.normal(-1, 1, (3000, len(q.NAMES)))}
    model = q.fit({c: q.moments(v) for c, v in x.items()})
    z = (x[0][:5] - model.scale[0]) / model.scale[1]
    want = []
    for mean, inverse, _ in model.parts:
        cov = np.linalg.inv(inverse) @ np.linalg.inv(inverse).T
        d = z - mean
        want.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(model.raw(x[0][:5]), want[1] - want[0])
    histogram = np.stack([np.bincount(q.bin_of(model.raw(x[c])), minlength=q.BINS) for c in (0, 1)]).astype(float)
    q.calibrate(model, histogram)
    assert model.score(x[1]).mean() > 0.99 and model.score(x[0]).mean() < 0.01


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    truth = dict(duckdb.sql(f"select doc_id, quality from '{path}/labels.parquet'").fetchall())
    rows = q.query(spark, path).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.95


def test_edges(spark):
    rows = [(1, None, "x", "l"), (2, "", "x", "l"), (None, "some words", "x", "l"), (4, "word " * 100_000, "x", "l"), (4, "other", "x", "l")]
    docs = spark.createDataFrame(rows, SCHEMA)
    none = spark.createDataFrame([], LABELS)
    model = q.train(q.labelled(q.featured(docs), none))
    assert {r.score for r in q.score(q.featured(docs), model).collect()} == {0.5}
    kept = q.keep_good(docs, none)
    assert kept.columns == docs.columns and kept.count() == 5
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 5)] + [(4, None, 0), (4, 1, 0), (None, 1, 0)], LABELS)
    assert all(0 <= r.score <= 1 for r in q.score(q.featured(docs), q.train(q.labelled(q.featured(docs), labels))).collect())
    empty = spark.createDataFrame([], SCHEMA)
    assert q.score(q.featured(empty), q.train(q.labelled(q.featured(empty), labels))).collect() == []
