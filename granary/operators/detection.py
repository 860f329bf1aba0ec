"""Boxes, matching, suppression and detection scores; images and annotations as tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..dual import Book
from ..session import scratch
from .corpus import running_total
from .ordering import numbered, numbered_within

BOOK = Book()
add, both = BOOK.add, BOOK.both
read = lambda spark, sf_dir, name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
THRESHOLDS = [0.5 + 0.05 * i for i in range(10)]


def area(b: str) -> Column:
    return F.greatest(F.lit(0.0), F.col(f"{b}.x2") - F.col(f"{b}.x1")) * F.greatest(F.lit(0.0), F.col(f"{b}.y2") - F.col(f"{b}.y1"))


def iou(a: str, b: str) -> Column:
    """Intersection over union of two struct columns (x1, y1, x2, y2)."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(F.col(f"{a}.{hi}"), F.col(f"{b}.{hi}")) - F.greatest(F.col(f"{a}.{lo}"), F.col(f"{b}.{lo}")))
    inter = side("x1", "x2") * side("y1", "y2")
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def corners(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return F.struct((cx - w / 2).alias("x1"), (cy - h / 2).alias("y1"), (cx + w / 2).alias("x2"), (cy + h / 2).alias("y2"))


def _iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    inter = np.clip(high - low, 0, None).prod(2)
    size = lambda x: np.clip(x[:, 2:] - x[:, :2], 0, None).prod(1)
    union = size(a)[:, None] + size(b)[None, :] - inter
    return np.where(union > 0, inter / np.where(union > 0, union, 1), 0.0)


BOX = ["x1", "y1", "x2", "y2"]


#: Rows of images that are worked on together; an image's boxes are never apart.
TOGETHER = 20_000


def _groups(table: pd.DataFrame) -> dict[tuple, np.ndarray]:
    """Row positions of each (image, label)."""
    return {k: np.sort(v) for k, v in table.groupby(["image", "label"], sort=True).indices.items()} if len(table) else {}


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("_bucket", F.pmod(F.xxhash64("image"), F.lit(buckets)))


def suppress(predictions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Greedy class-aware suppression within (image, label): by score, a box goes if it overlaps a kept one by more."""
    buckets = max(1, -(-predictions.count() // TOGETHER))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop(columns="_bucket").sort_values(["score", "box"], ascending=[False, True], kind="stable").reset_index(drop=True)
        boxes, keep = pdf[BOX].to_numpy(float), np.zeros(len(pdf), bool)
        for at in _groups(pdf).values():
            over = _iou_matrix(boxes[at], boxes[at]) > threshold
            kept: list[int] = []
            for i in range(len(at)):
                if not over[i, kept].any():
                    kept.append(i)
            keep[at[kept]] = True
        return pdf[keep]

    return _bucketed(predictions, buckets).groupBy("_bucket").applyInPandas(run, predictions.schema)


def match(predictions: DataFrame, targets: DataFrame) -> DataFrame:
    """(image, label, box, score, hits): by falling score, each prediction takes the free target of the largest overlap, for
    each threshold of 0.50 to 0.95; hits has a flag for each.  Images are dealt into buckets of some TOGETHER boxes."""
    schema = "image long, label int, box int, score double, hits array<boolean>"
    buckets = max(1, -(-predictions.count() // TOGETHER))

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):  # a side without rows comes without columns
            none = pd.DataFrame({"image": [], "label": [], "box": [], "score": [], "hits": []})
            return none.astype({"image": "int64", "label": "int32", "box": "int32", "score": "float64", "hits": object})
        left = left.sort_values(["score", "box"], ascending=[False, True], kind="stable").reset_index(drop=True)
        hits = np.zeros((len(left), len(THRESHOLDS)), bool)
        if len(right):
            right = right.sort_values("box", kind="stable").reset_index(drop=True)
            theirs, a, b = _groups(right), left[BOX].to_numpy(float), right[BOX].to_numpy(float)
            for group, at in _groups(left).items():
                if group not in theirs:
                    continue
                overlap = _iou_matrix(a[at], b[theirs[group]])
                for t, limit in enumerate(THRESHOLDS):
                    free = np.ones(overlap.shape[1], bool)
                    for i in np.flatnonzero(overlap.max(1) >= limit):
                        j = int(np.where(free, overlap[i], -1.0).argmax())
                        if free[j] and overlap[i, j] >= limit:
                            free[j] = False
                            hits[at[i], t] = True
        return pd.DataFrame({"image": left["image"], "label": left["label"], "box": left["box"], "score": left["score"], "hits": hits.tolist()})

    targets = targets.select(*[F.col(c).alias(c) for c in targets.columns])  # a table matched against itself needs names of its own
    return _bucketed(predictions, buckets).groupBy("_bucket").cogroup(_bucketed(targets, buckets).groupBy("_bucket")).applyInPandas(run, schema)


# The areas in pixels that small, medium and large boxes have, upper ends excluded.
SIZES = (("small", 0.0, 32.0**2), ("medium", 32.0**2, 96.0**2), ("large", 96.0**2, float("inf")))
SCOPES = ("all", *[name for name, _, _ in SIZES])


@dataclass(frozen=True)
class State:
    """What the scores need of the images seen so far: matches(scope, label, score, image, box, hits), counts(scope, label, targets).

    States of disjoint sets of images add up: rows of matches stand side by side, and counts are summed when scores are taken.
    """

    matches: DataFrame
    counts: DataFrame

    def merged(self, other: State) -> State:
        return State(self.matches.unionByName(other.matches), self.counts.unionByName(other.counts))

    def save(self, path: str) -> None:
        self.matches.write.parquet(f"{path}/matches")
        self.counts.write.parquet(f"{path}/counts")

    @staticmethod
    def load(spark: SparkSession, path: str) -> State:
        return State(spark.read.parquet(f"{path}/matches"), spark.read.parquet(f"{path}/counts"))


def _scoped(boxes: DataFrame, image_size: float) -> DataFrame:
    """Each box once in scope 0, all, and once in that of its size; the label carries the scope, so that scopes don't meet."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.col(hi) - F.col(lo))
    area = side("x1", "x2") * side("y1", "y2") * float(image_size) ** 2
    size = reduce(lambda c, i: c.when(area < SIZES[i][2], i + 1), range(1, len(SIZES)), F.when(area < SIZES[0][2], 1))
    scopes = F.explode(F.array(F.lit(0), size.otherwise(F.lit(len(SIZES)))))
    return boxes.withColumn("_scope", scopes).withColumn("label", (F.col("label") * len(SCOPES) + F.col("_scope")).cast("int")).drop("_scope")


def _unscoped(rows: DataFrame) -> DataFrame:
    scope = F.get(F.array(*map(F.lit, SCOPES)), F.pmod("label", F.lit(len(SCOPES))))
    return rows.withColumn("scope", scope).withColumn("label", F.floor(F.col("label") / len(SCOPES)).cast("int"))


def partial_state(predictions: DataFrame, targets: DataFrame, image_size: float = 1.0) -> State:
    """The state of some images, in all and by size: boxes of a size are matched with targets of that size alone."""
    targets = _scoped(targets, image_size)
    matches = _unscoped(match(_scoped(predictions, image_size), targets)).select("scope", "label", "score", "image", "box", "hits")
    return State(matches, _unscoped(targets.groupBy("label").agg(F.count("*").alias("targets"))).select("scope", "label", "targets"))


def average_precision(state: State) -> DataFrame:
    """(scope, label, threshold, ap): area under the precision envelope of the score order, for each class with targets.

    Precision falls at a miss, so only hits are carried on once rows have their ranks. Ranks, hits before and the envelope are
    found over ranges or blocks of ranks: a class that has most of the boxes isn't one task's work.
    """
    keys = ["scope", "label", "threshold"]
    ranked = numbered_within(state.matches, ["scope", "label"], F.desc("score"), F.col("image"), F.col("box"))
    hits = ranked.select("scope", "label", "position", F.posexplode("hits").alias("threshold", "hit")).where("hit").withColumn("one", F.lit(1).cast("long"))
    curve = running_total(hits, keys, "position", "one").withColumn("p", (F.col("before") + 1) / (F.col("position") + 1)).withColumn("_at", F.floor(F.col("position") / 4096))
    tops = curve.groupBy(*keys, "_at").agg(F.max("p").alias("_top"))
    later = F.max("_top").over(Window.partitionBy(*keys).orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, -1))
    within = F.max("p").over(Window.partitionBy(*keys, "_at").orderBy(F.desc("position")))
    envelope = curve.withColumn("_within", within).join(tops.select(*keys, "_at", later.alias("_later")), [*keys, "_at"])
    areas = envelope.groupBy(*keys).agg(F.sum(F.greatest("_within", "_later")).alias("area"))
    classes = state.counts.groupBy("scope", "label").agg(F.sum("targets").alias("targets")).withColumn("threshold", F.explode(F.sequence(F.lit(0), F.lit(len(THRESHOLDS) - 1))))
    return classes.join(areas, keys, "left").select(*keys, F.coalesce(F.col("area") / F.col("targets"), F.lit(0.0)).alias("ap"))


def best_f1(state: State) -> DataFrame:
    """(best_f1, best_confidence): the largest F1 at overlap 0.50 over all cuts of the score order, and the first score that has it."""
    every = state.matches.where("scope = 'all'")
    placed = numbered(every.select("score", "label", "image", "box", F.col("hits")[0].alias("hit")), F.desc("score"), "label", "image", "box")
    hits = placed.where("hit").select("score", "position", F.lit(1).cast("long").alias("one"), F.lit(0).alias("k"))
    total = state.counts.where("scope = 'all'").agg(F.coalesce(F.sum("targets"), F.lit(0)).alias("t"))  # one row
    f1 = 2.0 * (F.col("before") + 1) / (F.col("position") + 1 + F.col("t"))  # a cut before a miss is better than one after it
    best = running_total(hits, ["k"], "position", "one").crossJoin(F.broadcast(total)).agg(F.max(F.struct(f1.alias("f1"), (-F.col("position")).alias("p"), "score")).alias("b"))
    none = every.agg(F.coalesce(F.max("score"), F.lit(1.0)).alias("top"))  # without a hit, the first cut; without boxes, 1
    return best.crossJoin(none).select(F.coalesce("b.f1", F.lit(0.0)).alias("best_f1"), F.coalesce("b.score", "top").alias("best_confidence"))


def scores_of(state: State, threshold: float = 0.5) -> DataFrame:
    """One row: AP at 0.50 and the mean over thresholds, in all and by size (means of classes with targets, 0 without any), precision,
    recall and F1 of scores over a threshold, and the best F1 with its score."""
    ap = average_precision(state)
    mean = lambda scope, *more: F.round(F.coalesce(F.avg(F.when(reduce(and_, [F.col("scope") == scope, *more]), F.col("ap"))), F.lit(0.0)), 6)
    areas = ap.agg(mean("all", F.col("threshold") == 0).alias("ap50"), mean("all").alias("ap"), *[mean(name).alias(f"ap_{name}") for name, _, _ in SIZES])
    total = state.counts.where("scope = 'all'").agg(F.coalesce(F.sum("targets"), F.lit(0)).alias("t"))
    over = state.matches.where((F.col("scope") == "all") & (F.col("score") >= threshold))
    kept = over.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("hits")[0].cast("int")), F.lit(0)).alias("tp")).crossJoin(total)
    p, r = F.col("tp") / F.greatest("n", F.lit(1)), F.col("tp") / F.greatest("t", F.lit(1))
    fixed = kept.select(F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))
    return areas.crossJoin(fixed).crossJoin(best_f1(state).withColumn("best_f1", F.round("best_f1", 6)))  # one row each


def written(state: State) -> State:
    """The state from the shared folder, so that what is taken from it doesn't match boxes again."""
    spark = state.matches.sparkSession
    path = scratch(spark, "detections")
    state.save(path)
    return State.load(spark, path)


def detection_scores(predictions: DataFrame, targets: DataFrame, threshold: float = 0.5, image_size: float = 1.0) -> DataFrame:
    """The scores of all images at once; boxes are in units of image_size pixels."""
    return scores_of(written(partial_state(predictions, targets, image_size)), threshold)


def clip_frames(frames: DataFrame, radius: int, stride: int) -> DataFrame:
    """(video, frame, offset, source): 2 * radius + 1 frames around each, clamped to the first and last frame."""
    n = F.count("*").over(Window.partitionBy("video"))
    rows = frames.withColumn("n", n).withColumn("offset", F.explode(F.sequence(F.lit(-radius), F.lit(radius))))
    return rows.select("video", "frame", "offset", F.least(F.greatest(F.col("frame") + F.col("offset") * stride, F.lit(0)), F.col("n") - 1).cast("long").alias("source"))


# ---- queries: boxes made from line items ---------------------------------------------------------------------------


def _boxes(s, d, shift: float = 0.0) -> DataFrame:
    rows = read(s, d, "lineitem").select(F.col("l_orderkey").alias("image"), F.pmod("l_suppkey", F.lit(3)).cast("int").alias("label"), (F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))).alias("box"), F.col("l_quantity").alias("x1"), F.pmod("l_partkey", F.lit(40)).cast("double").alias("y1"), (F.col("l_discount") * 10).alias("score"))
    return rows.select("image", "label", "box", (F.col("x1") + shift * F.pmod("box", F.lit(3))).alias("x1"), "y1", (F.col("x1") + 20 + shift).alias("x2"), (F.col("y1") + 20).alias("y2"), "score")


def _by_parts(s, d) -> DataFrame:
    """The scores of each class from the merged states of three sets of images, each matched and saved by itself."""
    part, states = F.pmod(F.xxhash64("image"), F.lit(3)), []
    for i in range(3):  # together all images
        states.append(written(partial_state(_boxes(s, d, 3.0).where(part == i), _boxes(s, d).where(part == i))))
    state = reduce(State.merged, states)
    seen = state.matches.where("scope = 'all'").groupBy("label").agg(F.count("*").alias("predictions"), F.sum(F.col("hits")[0].cast("int")).alias("matches"))
    targets = state.counts.where("scope = 'all'").groupBy("label").agg(F.sum("targets").alias("targets"))
    ap = average_precision(state).where("scope = 'all'").groupBy("label").agg(F.round(F.avg("ap"), 6).alias("ap"))
    return seen.join(targets, "label").join(ap, "label")


add("win14_greedy_matching", lambda s, d: match(_boxes(s, d, 3.0), _boxes(s, d)).select("image", "label", "box", F.size(F.filter("hits", lambda h: h)).alias("thresholds")))
add("win15_suppression", lambda s, d: suppress(_boxes(s, d), 0.3).select("image", "label", "box"))
add("met17_detection_scores", lambda s, d: detection_scores(_boxes(s, d, 3.0), _boxes(s, d)))
add("met18_scores_by_image", lambda s, d: match(_boxes(s, d, 3.0), _boxes(s, d)).groupBy("image").agg(F.avg(F.col("hits")[0].cast("double")).alias("precision"), F.max("score").alias("top")))
add("agg35_partial_state", _by_parts)
both("src22_column_projection", "SELECT vec_id, label FROM {embeddings} ")
add("src24_video_clips", lambda s, d: clip_frames(read(s, d, "events").select(F.col("user_id").alias("video"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("frame")), 2, 3), "WITH f AS (SELECT user_id AS video, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT video, frame, CAST(o AS INTEGER) AS \"offset\", least(greatest(frame + o * 3, 0), n - 1) AS source FROM f, range(-2, 3) r(o)")
both("src25_modalities", "SELECT user_id, event_type, min(event_id) AS path FROM {events} GROUP BY user_id, event_type")

QUERIES, ORACLES = BOOK.queries, BOOK.oracles
