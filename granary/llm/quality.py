"""Quality by regularised quadratic discriminant analysis over transformed document statistics.

Statistics of a whole text (sizes, shares of kinds of characters, repetition of words, lines and 5-word shingles, word lengths)
are transformed (logarithms of sizes, logits of shares), so that each class is close to a normal distribution.  For each label the
mean and covariance come from distributed sums over the labelled rows of the training fold (in ``keep_good`` over at most some
TRAIN_ROWS of them, those of the smallest hash of their id, so that no text is shuffled or scored for nothing).  A class covariance
is shrunk towards the pooled one, and both towards its diagonal; Cholesky factors and their inverses are computed once and cached
in the model.  The raw score
of a text is the difference of the two Mahalanobis log-densities; a logistic curve, fitted on a histogram of fixed size of the
training rows' raw scores, turns it into a probability of label 1.

A null text is an empty text and gets a score like any other.  Labels, language, source and ids are no inputs.  A doc_id with
several labels or rows takes part once for each.  With fewer than 2 rows of a label every score is the share of label 1 (0.5
without labels).  Null doc_ids are kept and never learned from; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._core import LOWER, U64, column, lean, mix, prefix_hash, read_table, slices, span_hash, text_buffer, words, written

THRESHOLD = 0.3
#: Weight of the pooled covariance in a class's, and of the diagonal in both.
POOL, DIAGONAL = 0.1, 0.05
BINS, SPAN = 512, 200.0
#: The documented bound of the labels that keep_good learns from; so many are broadcast (16 bytes each).
TRAIN_ROWS = 200_000

_KIND = np.zeros(256, np.int64)  # 0 other ASCII, 1 lower, 2 upper, 3 digit, 4 white, 5 sentence, 6 symbol, 7 multi-byte
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_KIND[[ord(c) for c in ".,;:?'\""]] = 5
_KIND[[ord(c) for c in "!#$%&*|<>{}[]\\^~=+_@/"]] = 6
_KIND[128:] = 7
NAMES = ("bytes", "words", "word_length", "word_spread", "upper", "digit", "white", "sentence", "symbol", "bang", "bar", "multi_byte", "feeds", "short_words", "long_words", "symbol_ends", "new_words", "new_shingles", "new_lines", "top_word")


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive bounds; 0 where two bounds are equal."""
    total = np.r_[0, np.cumsum(values, dtype=np.float64)]
    return total[first[1:]] - total[first[:-1]]


def _distinct(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many different codes each row has, and the count of its most frequent one."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((codes, row))
    codes, row = codes[order], row[order]
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    run = np.diff(np.r_[at, len(codes)])
    top = np.zeros(len(first) - 1, np.int64)
    np.maximum.at(top, row[at], run)
    return np.bincount(row[at], minlength=len(first) - 1), top


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, len(NAMES)) transformed statistics of whole texts."""
    n = np.diff(offsets).astype(np.float64)
    kind = _KIND[data]
    share = {k: _sums(kind == k, offsets) for k in range(1, 8)}
    bang, bar, feeds = (_sums(data == ord(c), offsets) for c in "!|\n")
    low = LOWER[data]
    start, end, first = words(low, offsets)
    size = (end - start).astype(np.float64)
    w = np.diff(first).astype(np.float64)
    mean = _sums(size, first) / np.maximum(w, 1)
    spread = np.sqrt(np.maximum(_sums(size * size, first) / np.maximum(w, 1) - mean**2, 0))
    short, long = _sums(size <= 3, first), _sums(size >= 12, first)
    ends = _sums(kind[end - 1] == 6, first) if len(end) else np.zeros(len(n))
    hashes = prefix_hash(low)
    codes = span_hash(hashes, start, end)
    new_words, top = _distinct(codes, first)
    run = np.zeros(max(0, len(codes) - 4), U64)
    for i in range(5):
        run = run * U64(0xE7037ED1A0B428DB) + codes[i : len(codes) - 4 + i] if len(codes) > 4 else run
    # runs over a row's end are left out: each row has its word count less 4
    inside = np.ones(len(run), bool)
    for i in range(1, 5):
        bound = first[1:-1] - i
        inside[bound[(bound >= 0) & (bound < len(run))]] = False
    count = np.maximum(np.diff(first) - 4, 0)
    kept = np.flatnonzero(inside)
    row_of = np.searchsorted(first, kept, "right") - 1
    new_runs, _ = _distinct(mix(run[kept]), np.searchsorted(row_of, np.arange(len(first))))
    feed = np.flatnonzero(data == 10)
    line_start = np.unique(np.r_[offsets[:-1][n > 0], feed + 1])
    line_start = line_start[line_start < len(data)]
    line_end = np.r_[line_start[1:], len(data)][: len(line_start)]
    line_first = np.searchsorted(line_start, offsets)
    new_lines, _ = _distinct(span_hash(hashes, line_start, line_end), line_first)
    lines = np.diff(line_first)

    def logit(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        p = (part + 0.5) / (whole + 1)
        return np.log(p / (1 - p + 1e-9))

    letters = share[1] + share[2]
    return np.column_stack([
        np.log1p(n), np.log1p(w), np.log1p(mean), np.log1p(spread), logit(share[2], letters), logit(share[3], n), logit(share[4], n), logit(share[5], n), logit(share[6], n), logit(bang, n), logit(bar, n),
        logit(share[7], n), logit(feeds, n), logit(short, w), logit(long, w), logit(ends, w), np.log((new_words + 1) / (w + 1)) / np.log(w + 3), logit(count - new_runs, count), logit(lines - new_lines, lines), logit(top, w),
    ])


@dataclass
class Model:
    """Standardisation, and for each label mean, inverse of the Cholesky factor and log-determinant; slope and offset of the score."""

    share: float = 0.5
    scale: tuple | None = None
    parts: list = field(default_factory=list)
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-density under label 1 less that under label 0."""
        x = (x - self.scale[0]) / self.scale[1]
        out = []
        for mean, inverse, logdet in self.parts:
            z = (x - mean) @ inverse.T
            out.append(-0.5 * (z * z).sum(1) - 0.5 * logdet)
        return out[1] - out[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.parts:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.offset, -60, 60)))


def moments(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    return len(x), x.sum(0), x.T @ x


def fit(sums: dict[int, tuple[int, np.ndarray, np.ndarray]]) -> Model:
    """A model, without the logistic curve, from count, sum and sum of products of each label."""
    n = {c: s[0] for c, s in sums.items()}
    total = sum(n.values())
    model = Model(share=n.get(1, 0) / total if total else 0.5)
    if min(n.get(0, 0), n.get(1, 0)) < 2:
        return model
    mean = {c: s[1] / s[0] for c, s in sums.items()}
    cov = {c: s[2] / s[0] - np.outer(mean[c], mean[c]) for c, s in sums.items()}
    centre = sum(s[1] for s in sums.values()) / total
    pooled = sum(n[c] * cov[c] for c in cov) / total
    width = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    model.scale = (centre, width)
    norm = np.outer(width, width)
    for c in (0, 1):
        s = (1 - POOL) * cov[c] / norm + POOL * pooled / norm
        s = (1 - DIAGONAL) * s + DIAGONAL * np.diag(np.diag(s)) + 1e-3 * np.eye(len(s))
        factor = np.linalg.cholesky(s)
        model.parts.append(((mean[c] - centre) / width, np.linalg.inv(factor), 2 * float(np.log(np.diag(factor)).sum())))
    return model


def calibrate(model: Model, histogram: np.ndarray) -> None:
    """Slope and offset of a logistic curve on (2, BINS) counts of the raw scores by label, by Newton steps."""
    x = (np.arange(BINS) + 0.5) / BINS * 2 - 1  # raw scores squashed to -1..1
    x = SPAN * np.tan(x * np.pi / 2) / 50
    x = np.clip(x, -40, 40)
    a, b = 0.3, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        n = histogram.sum(0)
        g = np.array([((histogram[1] - n * p) * x).sum() - 1e-2 * a, (histogram[1] - n * p).sum()])
        w = n * p * (1 - p) + 1e-9
        h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -0.5, 0.5)), b + float(np.clip(step[1], -2, 2))
        a = max(a, 1e-3)
    model.slope, model.offset = a, b


def bin_of(raw: np.ndarray) -> np.ndarray:
    return np.clip(((np.arctan(raw * 50 / SPAN) * 2 / np.pi + 1) / 2 * BINS).astype(np.int64), 0, BINS - 1)


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the transformed statistics of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = statistics(*text_buffer(column(batch, "text")))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))
            yield pa.record_batch([column(batch, "doc_id"), flat], names=["doc_id", "x"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(lean(run), "doc_id long, x array<double>")


def _matrix(array: pa.Array) -> np.ndarray:
    return array.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))


def train(rows: DataFrame) -> Model:
    """A model from rows (x, label); what reaches the driver is 16 partial sums and a histogram, whatever the data."""
    width = len(NAMES)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {c: np.zeros(1 + width + width * width) for c in (0, 1)}
        for batch in batches:
            x, label = _matrix(column(batch, "x")), column(batch, "label").to_numpy()
            for c in (0, 1):
                n, s, p = moments(x[label == c])
                sums[c] += np.r_[n, s, p.ravel()]
        yield pa.record_batch([pa.array([0, 1]), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["label", "x"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {c: np.zeros(1 + width + width * width) for c in (0, 1)}
        for batch in batches:
            for c, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[c] += v
        yield pa.record_batch([pa.array([0, 1]), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["label", "x"])

    spec = "label long, x array<double>"
    total = {c: np.zeros(1 + width + width * width) for c in (0, 1)}
    for row in rows.select("label", "x").mapInArrow(lean(add), spec).repartition(8).mapInArrow(lean(merge), spec).collect():
        total[row.label] += row.x
    model = fit({c: (int(v[0]), v[1 : 1 + width], v[1 + width :].reshape(width, width)) for c, v in total.items() if v[0]})
    if model.parts:
        shared = rows.sparkSession.sparkContext.broadcast(model)

        def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.record_batch([column(batch, "label"), pa.array(bin_of(shared.value.raw(_matrix(column(batch, "x")))))], names=["label", "bin"])

        histogram = np.zeros((2, BINS))
        for row in rows.select("label", "x").mapInArrow(lean(bins), "label long, bin long").groupBy("label", "bin").count().collect():
            histogram[row.label, row.bin] = row["count"]
        calibrate(model, histogram)
    return model


def fold_column(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)), F.lit(0))


def labelled(features: DataFrame, labels: DataFrame) -> DataFrame:
    """(x, label) of the rows of the training fold."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("long").alias("label")).where("label in (0, 1)")
    return features.where(F.col("doc_id").isNotNull() & (fold_column() != 0)).join(marks, "doc_id")  # only numbers move


def labelled_first(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """As labelled, with statistics of the labelled documents alone; of more than TRAIN_ROWS labels about so many."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("long").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (fold_column() != 0))
    n = marks.count()
    if n > TRAIN_ROWS:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < int((1 << 32) * TRAIN_ROWS / n))
    marks = written(marks, "marks")
    few = marks.select("doc_id").distinct()
    some = docs.withColumn("__id", F.col("doc_id").cast("long")).join(F.broadcast(few.withColumnRenamed("doc_id", "__id")), "__id", "left_semi").drop("__id")
    return labelled(featured(some), F.broadcast(marks).withColumnRenamed("label", "quality"))


def score(features: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) from (doc_id, x)."""
    shared = features.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([column(batch, "doc_id"), pa.array(shared.value.score(_matrix(column(batch, "x"))))], names=["doc_id", "score"])

    return features.select("doc_id", "x").mapInArrow(lean(run), "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches THRESHOLD; trained on the labelled ones."""
    model = train(written(labelled_first(docs, labels), "labelled"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            keep = shared.value.score(statistics(*text_buffer(column(batch, "text")))) >= THRESHOLD
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = written(featured(read_table(spark, sf_dir, "documents")), "features")
    model = train(written(labelled(features, read_table(spark, sf_dir, "labels")), "labelled"))
    out = score(features, model)
    return out.select("doc_id", (fold_column() == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
