import duckdb
import numpy as np
import pytest
from pyspark.sql import types as T

from granary.llm import language_id as li

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("score", T.StringType())])


@pytest.fixture(scope="module")
def model(spark):
    from granary.llm._core import read_table

    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    from pyspark.sql import functions as F

    return li.train(li.sample(docs, F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1))


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    model = {k: v if k == "labels" else v.astype(np.float64) for k, v in li.new_model(["a", "b", "c"], 3).items()}
    codes, target = rng.integers(0, 256, (7, 5)), rng.integers(0, 3, 5)
    weight = rng.random((7, 5))
    _, grads = li.loss_and_grads(model, codes, target, weight)
    for k, g in grads.items():
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in g.shape)
            if k.endswith(".w") and k[0] in "fb":
                at = (at[0], int(codes[rng.integers(7), rng.integers(5)]))
            old, step = model[k][at], 1e-2
            model[k][at] = old + step
            up = li.loss_and_grads(model, codes, target, weight)[0]
            model[k][at] = old - step
            down = li.loss_and_grads(model, codes, target, weight)[0]
            model[k][at] = old
            assert abs((up - down) / (2 * step) - g[at]) < 0.02 * max(0.05, abs(g[at])), k


def test_both_forms_of_the_network_agree(model):
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 256, (li.WINDOW, 9))
    for side in "fb":
        assert np.allclose(li._states(model, side, codes), li._forward(model, side, codes)[0], atol=1e-5)


def test_every_position_is_labelled(model):
    text = ("The words of and " * 30).encode()
    data = np.frombuffer(text, np.uint8)
    p = li.label_positions(model, data, np.array([0, 100, 100, len(data)]))
    assert p.shape == (len(data), len(model["labels"])) and np.allclose(p.sum(1), 1, atol=1e-4)
    # a row's labels don't depend on its neighbours
    assert np.allclose(p[:100], li.label_positions(model, data[:100], np.array([0, 100])), atol=1e-5)


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    truth = dict(duckdb.sql(f"select doc_id, lang from '{path}/documents.parquet'").fetchall())
    rows = li.query(spark, path).collect()
    assert len(rows) == len(truth) and all(r.held_out == (li.fold_of(r.doc_id, 3) == 1) for r in rows)
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert len(held) > 200 and np.mean(held) > 0.97


def test_sample_is_the_smallest_hashes(spark, monkeypatch):
    """With a document that has a third of all rows, and pieces of whole windows of bytes."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(li, "SAMPLE", 20)
    rows = [(i, "é" * 200 + str(i), "fr" if i % 3 else "en", "s") for i in range(3000)] + [(7, "hot " * 50, "de", "s")] * 1500 + [(9000 + i, "rare", "de", "s") for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    pieces = li.sample(df)
    assert {len(p) for p, lang in pieces if lang != "de"} == {li.WINDOW} and len(pieces) == 3 * 20 * li.CUTS
    keys = {r.doc_id: r.k for r in df.select("doc_id", F.shiftrightunsigned(F.xxhash64("doc_id"), 1).alias("k")).distinct().collect()}
    hot = sorted([7, *range(9000, 9030)], key=keys.get)[:20]
    assert sum(p.startswith(b"hot") or b"hot" in p for p, _ in pieces) == li.CUTS * (7 in hot)


def test_rows_against_the_network_text_by_text(spark, model):
    """Predictions and scores against running the training form of the network over each text's windows."""
    texts = ["the of and to " * 9, "", "123 !", "le la é des " * 40, "x", "der und die " * 700, "1 a 2"]
    got = {r.doc_id: r for r in li.predict(spark.createDataFrame([(i, t, None, "s") for i, t in enumerate(texts)], SCHEMA).repartition(2), model).collect()}
    for i, t in enumerate(texts):
        data = t.encode()
        total, n = np.zeros(len(model["labels"])), 0
        for at in range(0, len(data), li.WINDOW):
            part = np.frombuffer(data[at : at + li.WINDOW], np.uint8)
            # the last window is padded as its batch asks; alone it is not padded
            codes = part.astype(np.int64)[:, None]
            both = np.concatenate([li._forward(model, s, codes)[0] for s in "fb"], 1)[:, :, 0]
            logits = both @ model["o.w"].T + model["o.b"].T
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            total, n = total + p[li.LETTER[part]].sum(0), n + int(li.LETTER[part].sum())
        if not n:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
        elif len(data) % li.WINDOW == 0 or len(data) > 20 * li.WINDOW:
            assert got[i].lang_pred == model["labels"][int(total.argmax())] and abs(got[i].score - total.max() / n) < 2e-2
        else:
            assert got[i].lang_pred in model["labels"]


def test_letters_like_the_pattern():
    import pyarrow as pa

    from granary.llm._core import text_buffer

    texts = ["", None, "a", "1 2", "é", "１２", "ы", "–…", "_", "1é", "Z", "日本"]
    column = pa.array(texts)
    assert li.with_letters(column, *text_buffer(column)).tolist() == [bool(li._LETTER.search(t or "")) for t in texts]


def test_edges(spark, model):
    rows = [(1, None, "en", "s"), (2, "", "en", "s"), (3, "12 34 !!", "en", "s"), (None, "the of and ing", None, "s"), (4, "the thing and " * 20000, None, "s"), (4, "ы", None, "s")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = [(r.doc_id, r.lang_pred, r.score) for r in li.predict(df, model).collect()]
    assert out[:3] == [(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)]
    assert all(p in model["labels"] and 0 < s <= 1 for _, p, s in out[3:]) and len(out) == 6
    assert li.train([]) is None and li.train([(b"12", "en")]) is None
    assert {r.lang_pred for r in li.predict(df, None).collect()} == {"und"}
    assert li.sample(spark.createDataFrame([], SCHEMA)) == []
    assert li.predict(spark.createDataFrame([], SCHEMA), model).collect() == []
