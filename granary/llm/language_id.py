"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

A text's UTF-8 bytes are cut into windows of WINDOW bytes.  Over each window a forward and a backward GRU run from zero states;
at every position a softmax over both states labels the byte.  A document's probabilities are the mean over its positions that
belong to letters (a-z, A-Z and bytes of 128 and more); the largest is the prediction and its score.

Training is back-propagation through time with Adam on at most SAMPLE documents of each language, those of the smallest hash of
their id, and CUTS pieces of WINDOW bytes of each.  Counts by language give a threshold of the hash that some 2 * SAMPLE
documents pass; only these are read further, and no task orders a language.  What comes to the driver is bounded by about
languages * 2 * SAMPLE * CUTS * WINDOW bytes.  Weights are seeded: the same table gives the same model.

A null text, or one without a letter, is ``und`` with score 0.  Rows without a language are never learned from; where no row
has one, every prediction is ``und``.  Null and repeated doc_ids are kept, extra columns ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._core import column, lean, read_table, slices, text_buffer

HIDDEN, WINDOW = 12, 64
#: The documented bound of the training sample: documents of each language, and pieces of WINDOW bytes of each.
SAMPLE, CUTS = 300, 6
STEPS, BATCH, RATE = 360, 192, 0.012
_LETTER = re.compile(r"[^\W\d_]")


def _forward(model: dict, side: str, codes: np.ndarray) -> tuple[np.ndarray, list]:
    """States (T, HIDDEN, B) over codes (T, B), and what back-propagation needs."""
    w, u, bias = model[f"{side}.w"], model[f"{side}.u"], model[f"{side}.b"]
    steps, width = codes.shape
    h = np.zeros((HIDDEN, width), np.float32)
    states, kept = np.empty((steps, HIDDEN, width), np.float32), []
    order = range(steps) if side == "f" else range(steps - 1, -1, -1)
    for t in order:
        x = w[:, codes[t]]
        g = u @ h
        gates = 0.5 + 0.5 * np.tanh(0.5 * (x[: 2 * HIDDEN] + g[: 2 * HIDDEN]))
        r, z = gates[:HIDDEN], gates[HIDDEN:]
        inner = g[2 * HIDDEN :] + bias
        n = np.tanh(x[2 * HIDDEN :] + r * inner)
        kept.append((t, h, r, z, inner, n))
        h = n + z * (h - n)
        states[t] = h
    return states, kept


def _backward(model: dict, side: str, codes: np.ndarray, kept: list, above: np.ndarray, grads: dict) -> None:
    """Back-propagation through time of the gradients `above` of all states."""
    u = model[f"{side}.u"]
    carry = np.zeros_like(above[0])
    gw, gu, gb = (np.zeros_like(model[f"{side}.{k}"]) for k in "wub")
    inputs, places = [], []
    for t, h, r, z, inner, n in reversed(kept):
        d = above[t] + carry
        dn = d * (1 - z) * (1 - n * n)
        dz = d * (h - n) * z * (1 - z)
        dr = dn * inner * r * (1 - r)
        dx = np.concatenate([dr, dz, dn])
        dg = np.concatenate([dr, dz, dn * r])
        inputs.append(dx)
        places.append(codes[t])
        gu += dg @ h.T
        gb += (dn * r).sum(1, keepdims=True)
        carry = d * z + u.T @ dg
    every, place = np.concatenate(inputs, 1), np.concatenate(places)
    for row in range(len(gw)):
        gw[row] = np.bincount(place, every[row], minlength=256)
    grads[f"{side}.w"], grads[f"{side}.u"], grads[f"{side}.b"] = gw, gu, gb


def new_model(labels: list[str], seed: int = 7) -> dict:
    rng = np.random.default_rng(seed)
    out: dict = {"labels": labels}
    for side in "fb":
        out[f"{side}.w"] = (0.3 * rng.standard_normal((3 * HIDDEN, 256))).astype(np.float32)
        out[f"{side}.u"] = (rng.standard_normal((3 * HIDDEN, HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
        out[f"{side}.b"] = np.zeros((HIDDEN, 1), np.float32)
    out["o.w"] = (0.1 * rng.standard_normal((len(labels), 2 * HIDDEN))).astype(np.float32)
    out["o.b"] = np.zeros((len(labels), 1), np.float32)
    return out


def loss_and_grads(model: dict, codes: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
    """Mean cross-entropy of the positions (T, B) by weight, and its gradients."""
    grads: dict = {}
    f, kept_f = _forward(model, "f", codes)
    b, kept_b = _forward(model, "b", codes)
    both = np.concatenate([f, b], 1)
    logits = model["o.w"] @ both + model["o.b"]
    logits -= logits.max(1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(1, keepdims=True)
    at = np.arange(len(target))
    loss = -(np.log(np.maximum(p[:, target, at], 1e-12)) * weight).sum()
    p[:, target, at] -= 1
    d = p * weight[:, None, :]
    grads["o.w"] = np.einsum("tlb,thb->lh", d, both, optimize=True).astype(np.float32)
    grads["o.b"] = d.sum((0, 2))[:, None].astype(np.float32)
    down = np.matmul(model["o.w"].T, d)
    _backward(model, "f", codes, kept_f, down[:, :HIDDEN], grads)
    _backward(model, "b", codes, kept_b, down[:, HIDDEN:], grads)
    return float(loss), grads


LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def train(pieces: list[tuple[bytes, str]], seed: int = 7, steps: int = STEPS) -> dict | None:
    """A model from (bytes, language) pieces; every language weighs the same.  None without a piece that has a letter."""
    pieces = [(p[:WINDOW], lang) for p, lang in pieces if LETTER[np.frombuffer(p[:WINDOW], np.uint8)].any()]
    if not pieces:
        return None
    labels = sorted({lang for _, lang in pieces})
    model = new_model(labels, seed)
    codes = np.zeros((len(pieces), WINDOW), np.int64)
    for i, (piece, _) in enumerate(pieces):
        codes[i, : len(piece)] = np.frombuffer(piece, np.uint8)
    target = np.array([labels.index(lang) for _, lang in pieces])
    members = [np.flatnonzero(target == i) for i in range(len(labels))]
    rng = np.random.default_rng(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.items() if k != "labels"}
    for step in range(1, steps + 1):
        some = np.concatenate([rng.choice(m, -(-BATCH // len(labels))) for m in members])
        x = codes[some].T
        weight = LETTER[x].astype(np.float32)
        weight /= weight.sum()
        _, grads = loss_and_grads(model, x, target[some], weight)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = RATE * min(1, step / 20) * (0.5 + 0.5 * np.cos(np.pi * step / steps))
        for k, g in grads.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            model[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def _states(model: dict, side: str, codes: np.ndarray) -> np.ndarray:
    """As _forward, without what only training needs and with arrays used again."""
    w, u, bias = model[f"{side}.w"], model[f"{side}.u"], model[f"{side}.b"]
    half = np.float32(0.5)
    steps, width = codes.shape
    states = np.empty((steps, HIDDEN, width), np.float32)
    x, g = np.empty((3 * HIDDEN, width), np.float32), np.empty((3 * HIDDEN, width), np.float32)
    h = np.zeros((HIDDEN, width), np.float32)
    gates, inner = g[: 2 * HIDDEN], g[2 * HIDDEN :]
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        np.take(w, codes[t], axis=1, out=x, mode="clip")
        np.matmul(u, h, out=g)
        gates += x[: 2 * HIDDEN]
        gates *= half
        np.tanh(gates, out=gates)
        gates *= half
        gates += half
        inner += bias
        inner *= gates[:HIDDEN]
        inner += x[2 * HIDDEN :]
        np.tanh(inner, out=inner)
        after = states[t]
        np.subtract(h, inner, out=after)
        after *= gates[HIDDEN:]
        after += inner
        h = after
    return states


def label_positions(model: dict, data: np.ndarray, offsets: np.ndarray, group: int = 2048) -> np.ndarray:
    """(bytes, labels) float32: the probabilities of the languages at every byte of all rows."""
    sizes = np.diff(offsets)
    per = -(-sizes // WINDOW)
    row = np.repeat(np.arange(len(sizes)), per)
    number = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    start = offsets[:-1][row] + number * WINDOW
    length = np.minimum(WINDOW, offsets[1:][row] - start)
    order = np.argsort(-length, kind="stable")
    padded = np.r_[data, np.zeros(WINDOW, np.uint8)]
    out = np.empty((len(data), len(model["labels"])), np.float32)
    at = np.arange(WINDOW)
    for a in range(0, len(order), group):
        some = order[a : a + group]
        top = int(length[some[0]])
        places = start[some][:, None] + at[:top]
        inside = at[:top] < length[some][:, None]
        codes = np.where(inside, padded[places], 0).T.astype(np.int64)
        both = model["o.w"][:, :HIDDEN] @ _states(model, "f", codes)
        both += model["o.w"][:, HIDDEN:] @ _states(model, "b", codes)
        both += model["o.b"]
        both -= both.max(1, keepdims=True)
        np.exp(both, out=both)
        both /= both.sum(1, keepdims=True)
        out[places[inside]] = both.transpose(2, 0, 1)[inside]
    return out


def pool(model: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, labels): the mean of the letters' probabilities; zeros where a row has no letter."""
    positions = label_positions(model, data, offsets)
    letter = LETTER[data]
    positions[~letter] = 0
    sums = np.zeros((len(offsets) - 1, positions.shape[1]))
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        sums[full] = np.add.reduceat(positions, offsets[full], 0, dtype=np.float64)
        counts = np.add.reduceat(letter, offsets[full], dtype=np.int64)
        sums[full] /= np.maximum(counts, 1)[:, None]
    return sums


def sample(docs: DataFrame, fold: F.Column | None = None) -> list[tuple[bytes, str]]:
    """At most SAMPLE documents of each language, by the hash of their id, and CUTS pieces of each."""
    known = docs.where("lang is not null and text is not null and doc_id is not null")
    known = known.where(fold) if fold is not None else known
    known = known.withColumn("key", F.shiftrightunsigned(F.xxhash64("doc_id"), 1))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = {lang: min(1.0, (2 * SAMPLE + 60) / n) for lang, n in counts.items()}
    chosen: dict[str, list] = {}
    while open_ := [lang for lang in counts if lang not in chosen]:
        limits = F.create_map(*[F.lit(x) for lang in open_ for x in (lang, min((1 << 63) - 1, int(share[lang] * (1 << 63))))])
        body = F.col("text").cast("string").cast("binary")
        room = F.greatest(F.octet_length("text") - WINDOW, F.lit(0)) + 1
        cuts = F.array(*[F.substring(body, (F.pmod(F.xxhash64("doc_id", F.lit(j)), room) + 1).cast("int"), F.lit(WINDOW)) for j in range(CUTS)])
        # a document of many rows is one: its greatest pieces
        few = known.where(F.col("key") <= F.coalesce(F.element_at(limits, F.col("lang")), F.lit(-1).cast("long"))).groupBy("lang", "doc_id", "key").agg(F.max(cuts).alias("cuts"))
        found: dict[str, list] = {lang: [] for lang in open_}
        for row in few.collect():
            found[row.lang].append((row.key, row.doc_id, row.cuts))
        for lang, rows in found.items():
            if len(rows) >= SAMPLE or share[lang] >= 1:
                chosen[lang] = sorted(rows)[:SAMPLE]
            else:  # documents of many rows leave fewer than their count says
                share[lang] = min(1.0, 4 * share[lang])
    return [(bytes(piece), lang) for lang in sorted(chosen) for _, _, cuts in chosen[lang] for piece in cuts]


def with_letters(texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which rows have a letter; only texts without a-z and A-Z but with bytes beyond ASCII are looked at one by one."""
    full = np.diff(offsets) > 0
    plain, high = np.zeros(len(full), bool), np.zeros(len(full), bool)
    at = offsets[:-1][full]
    if len(at):
        plain[full] = np.logical_or.reduceat(LETTER[data] & (data < 128), at)
        high[full] = np.logical_or.reduceat(data >= 128, at)
    for i in np.flatnonzero(high & ~plain).tolist():
        plain[i] = bool(_LETTER.search(texts[i].as_py()))
    return plain


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, lang_pred, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = shared.value
        names = np.array(made["labels"] if made else ["und"], object)
        for batch in slices(batches, "text"):
            texts = column(batch, "text")
            data, offsets = text_buffer(texts)
            letters = with_letters(texts, data, offsets)
            if made:
                p = pool(made, data, offsets)
            else:
                p = np.zeros((len(letters), 1))
            best = p.argmax(1)
            label = np.where(letters, names[best], "und")
            score = np.where(letters, p[np.arange(len(p)), best], 0.0).clip(0, 1)
            yield pa.record_batch([column(batch, "doc_id"), pa.array(label.tolist(), pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(lean(run), "doc_id long, lang_pred string, score double")


def fold_of(doc_id: int, folds: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % folds


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    model = train(sample(docs, fold != 1))
    return predict(docs, model).select("doc_id", (F.coalesce(fold, F.lit(0)) == 1).alias("held_out"), "lang_pred", "score")
