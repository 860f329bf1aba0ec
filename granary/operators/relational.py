"""Joins, aggregates, rankings, sorts, samples and set operations on keyed tables, as the data tools around a model use them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dual import Book
from ..session import materialised
from . import measures
from .corpus import running_total
from .ordering import cut_of_hash, nearest_rank, numbered, zipped, numbered_within

BOOK = Book()
both, add = BOOK.both, BOOK.add
read = lambda spark, sf_dir, name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- operators -----------------------------------------------------------------------------------------------------


def override_join(examples: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """Examples with their metadata; where both have a column, the example's value wins unless it is null."""
    shared = [c for c in metadata.columns if c in examples.columns and c != key]
    right = metadata.withColumnsRenamed({c: f"_m_{c}" for c in shared})
    out = examples.join(right, key, "left")
    return out.withColumns({c: F.coalesce(c, f"_m_{c}") for c in shared}).drop(*[f"_m_{c}" for c in shared])


def exact_join_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(matched, missing, unused) of two key sets that should be the same."""
    both_ = left.select(F.col(key).alias("k"), F.lit(1).alias("l")).join(right.select(F.col(key).alias("k"), F.lit(1).alias("r")), "k", "full_outer")
    return both_.agg(F.count(F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), 1)).alias("matched"), F.count(F.when(F.col("r").isNull(), 1)).alias("missing"), F.count(F.when(F.col("l").isNull(), 1)).alias("unused"))


def weights_from_counts(counts: DataFrame, n: str = "n", mode: str = "inverse_sqrt") -> DataFrame:
    """Adds weight: 1, 1/n or 1/sqrt(n), scaled to a mean of 1 over the rows that occur."""
    raw = {"none": F.lit(1.0), "inverse": 1.0 / F.col(n), "inverse_sqrt": 1.0 / F.sqrt(F.col(n))}[mode]
    present = F.when(F.col(n) > 0, raw)
    return counts.withColumn("weight", present / F.avg(present).over(Window.partitionBy()))


def effective_number_weights(counts: DataFrame, beta: float = 0.999, low: float = 0.25, high: float = 4.0, n: str = "n") -> DataFrame:
    """Adds weight (1 - b) / (1 - b^n), mean-normalised over observed rows, then clamped."""
    raw = F.when(F.col(n) > 0, F.lit(1 - beta) / (1 - F.pow(F.lit(beta), F.col(n))))
    return counts.withColumn("weight", F.least(F.lit(high), F.greatest(F.lit(low), raw / F.avg(raw).over(Window.partitionBy()))))


def bounded_mean_one(weights: DataFrame, low: float, high: float, weight: str = "weight", steps: int = 64) -> DataFrame:
    """Adds bounded: weights times a common scale, clamped to [low, high], the scale bisected until their mean is 1.

    Each step is one aggregation over the distinct weights with their counts.
    """
    counted = materialised(weights.groupBy(weight).count(), "weights")
    a, b = 0.0, 1.0
    clamp = lambda scale: F.least(F.lit(high), F.greatest(F.lit(low), F.col(weight) * scale))
    mean = lambda scale: counted.agg(F.sum(clamp(F.lit(scale)) * F.col("count")) / F.sum("count")).first()[0]
    while mean(b) < 1 and b < 1e12:
        b *= 2
    grid = 16
    for _ in range(max(1, steps // 4)):
        points = [a + (b - a) * i / grid for i in range(grid + 1)]
        row = counted.agg(*[(F.sum(clamp(F.lit(p)) * F.col("count")) / F.sum("count")).alias(str(i)) for i, p in enumerate(points)]).first()
        i = max((i for i in range(grid + 1) if row[i] <= 1), default=0)
        a, b = points[i], points[min(grid, i + 1)]
    return weights.withColumn("bounded", clamp(F.lit(a)))


def calibration_error(rows: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over bins (lo, hi]; a confidence of 0 is in no bin but counts in the total."""
    total = rows.agg(F.count("*").alias("total"))
    binned = rows.where(F.col(confidence) > 0).groupBy(F.ceil(F.col(confidence) * bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("c"), F.avg(F.col(correct).cast("double")).alias("a"))
    return binned.crossJoin(F.broadcast(total)).agg(F.round(F.sum(F.col("n") / F.col("total") * F.abs(F.col("a") - F.col("c"))), 6).alias("error"))


def stable_order(seed: int, key: str) -> Column:
    """The pseudo-random place of a key: the hex digest of seed:key, which sorts like its bytes."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)


def surface_cap(rows: DataFrame, task: str, key: str, surface: str, cap: int, seed: int = 42) -> DataFrame:
    """At most cap rows of each task and surface, in pseudo-random order; blank surfaces aren't capped."""
    blank = F.coalesce(F.col(surface), F.lit("")) == ""  # these pass beside the window, which keeps cap rows of a group map-side
    rank = F.row_number().over(Window.partitionBy(task, surface).orderBy(stable_order(seed, key)))
    return rows.where(blank).unionByName(rows.where(~blank).withColumn("_r", rank).where(F.col("_r") <= cap).drop("_r"))


def balance(rows: DataFrame, task: str, key: str, limit: int, seed: int = 42) -> DataFrame:
    """Round robin over tasks: all first rows by task name, then all second ones, to the limit; all rows if they are fewer."""
    ranked = numbered_within(rows.withColumn("_o", stable_order(seed, key)), [task], "_o", out="_r")
    return ranked.orderBy("_r", task).limit(limit).drop("_r", "_o")


def with_replacement(rows: DataFrame, key: str, n: int, seed: int = 3) -> DataFrame:
    """The rows that n draws with replacement hit, with draws, how often; the i-th draw is the row at hash(seed, i) mod their number."""
    total = rows.count()
    picks = rows.sparkSession.range(n if total else 0).select(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(1, total))).alias("position"))
    return numbered(rows, key).join(picks.groupBy("position").agg(F.count("*").alias("draws")), "position").drop("position")


def deficit_quotas(counts: dict[str, int], weights: dict[str, float], limit: int, held: dict[str, int] | None = None) -> dict[str, int]:
    """How many rows of each task to add, one at a time to the largest deficit, ties to the largest name; on counts only."""
    given = dict.fromkeys(counts, 0)
    held = held or {}
    for _ in range(limit):
        total = sum(given.values()) + sum(held.values()) + 1
        open_ = [t for t in counts if given[t] < counts[t]]
        if not open_:
            break
        t = max(open_, key=lambda t: (weights.get(t, 0.0) * total - given[t] - held.get(t, 0), t))
        given[t] += 1
    return given


def weighted_balance(rows: DataFrame, task: str, key: str, weights: dict[str, float], limit: int, seed: int = 42) -> DataFrame:
    """Rows of each task up to its quota, in pseudo-random order; only the tasks' counts reach the driver."""
    counts = {r[0]: r[1] for r in rows.groupBy(task).count().collect()}
    quotas = deficit_quotas(counts, weights, limit)
    quota = F.coalesce(F.create_map(*[F.lit(x) for t, q in quotas.items() for x in (t, q)])[F.col(task)], F.lit(0)) if quotas else F.lit(0)
    ranked = numbered_within(rows.withColumn("_o", stable_order(seed, key)), [task], "_o", out="_r")
    return ranked.where(F.col("_r") < quota).drop("_r", "_o")


def curriculum_stage(rows: DataFrame, retained: DataFrame | None, task: str, key: str, limit: int, seed: int = 42) -> DataFrame:
    """A stage: what the stage before kept, and of the rest a balanced choice up to the limit."""
    if retained is None:
        return balance(rows, task, key, limit, seed)
    kept = rows.join(retained.select(key), key, "left_semi")
    room = max(0, limit - kept.count())
    return kept.unionByName(balance(rows.join(retained.select(key), key, "left_anti"), task, key, room, seed))


def hash_split(rows: DataFrame, key: str, held_out: float, seed: int = 42) -> DataFrame:
    """Adds held: exactly the last int(n * share) rows in pseudo-random order."""
    cut = int(rows.count() * (1 - held_out))
    return rows.withColumn("held", stable_order(seed, key) > F.lit(cut_of_hash(rows, stable_order(seed, key), cut)))


#: Vectors of a label that are compared with as many others at once, about.
TOGETHER = 512


def similar_pairs(vectors: DataFrame, over: float) -> DataFrame:
    """(left_id, right_id, dot): all pairs of vectors of one label whose dot product, rounded to 5 places, is more than `over`.

    The vectors of a label are dealt into blocks, and each pair of blocks is compared in a group of its own, so that no task holds
    a label.  Vectors of different lengths, or with nulls, have no dot product.
    """
    rows = vectors.where("label is not null and vec_id is not null and embedding is not null and not exists(embedding, x -> x is null)")
    rows = rows.select("label", F.size("embedding").alias("length"), "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    blocks = rows.groupBy("label", "length").agg(F.ceil(F.count("*") / TOGETHER).alias("blocks"))
    mine = rows.join(blocks, ["label", "length"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
    other = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = other.select("label", "length", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "vec_id", "v")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        ids, v, block = pdf["vec_id"].to_numpy(), np.stack(pdf["v"].to_numpy()), pdf["block"].to_numpy()
        apart = pdf["low"].iloc[0] != pdf["high"].iloc[0]
        left, right, dots = [], [], []
        for i in range(len(ids)):
            near = i + 1 + np.flatnonzero(~(v[i + 1 :] @ v[i] <= over - 0.01))  # what the product in any order may put over the limit
            near = near[(ids[near] > ids[i]) & (~apart | (block[near] != block[i]))]
            left.append(np.full(len(near), ids[i]))
            right.append(ids[near])
            dots.append(np.cumsum(v[near] * v[i], axis=1)[:, -1] if v.shape[1] else np.zeros(len(near)))  # summed from first to last
        return pd.DataFrame({"left_id": np.concatenate(left), "right_id": np.concatenate(right), "dot": np.concatenate(dots)})

    pairs = met.groupBy("label", "length", "low", "high").applyInPandas(run, f"left_id {dict(rows.dtypes)['vec_id']}, right_id {dict(rows.dtypes)['vec_id']}, dot double")
    return pairs.withColumn("dot", F.round("dot", 5)).where(F.col("dot") > over)


def overlapping_boxes(boxes: DataFrame, side: float, least: float) -> DataFrame:
    """(image, box_a, box_b, iou) of squares of one image and class that overlap by at least `least`; boxes: corners x, y."""
    both_ = boxes.alias("a").join(boxes.alias("c"), F.expr("a.image = c.image and a.class = c.class and a.box < c.box"))
    shared = lambda v: F.greatest(F.lit(0.0), F.least(f"a.{v}", f"c.{v}") + side - F.greatest(f"a.{v}", f"c.{v}"))
    rows = both_.select(F.col("a.image").alias("image"), F.col("a.box").alias("box_a"), F.col("c.box").alias("box_b"), (shared("x") * shared("y")).alias("inter"))
    iou = F.col("inter") / (2 * side * side - F.col("inter"))
    return rows.where(iou >= least).select("image", "box_a", "box_b", F.round(iou, 6).alias("iou"))


# ---- joins ---------------------------------------------------------------------------------------------------------

def _classes(s, d) -> DataFrame:
    return read(s, d, "lineitem").select(F.pmod("l_suppkey", F.lit(4)).alias("class"), "l_extendedprice", "l_orderkey", "l_linenumber", (F.pmod("l_partkey", F.lit(3)) == 0).alias("tp"))


def _routed(s, d) -> DataFrame:
    return read(s, d, "lineitem").select(F.col("l_linenumber").alias("layer"), F.pmod("l_suppkey", F.lit(8)).alias("expert"))


EX = "ex AS (SELECT d.doc_id, d.source AS task, d.lang AS mode, d.n_chars, l.quality, l.toxic FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id)"
add("jon01_override_join", lambda s, d: override_join(read(s, d, "documents").select("doc_id", F.when(F.pmod("doc_id", F.lit(3)) == 0, F.col("lang")).alias("lang"), "source"), read(s, d, "labels").select("doc_id", "quality", F.lit("xx").alias("lang")), "doc_id"), "SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 3 = 0 THEN d.lang END, CASE WHEN l.doc_id IS NOT NULL THEN 'xx' END) AS lang, d.source, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
add("jon02_exact_match", lambda s, d: exact_join_counts(read(s, d, "documents"), read(s, d, "labels"), "doc_id"), "SELECT count(*) FILTER (d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS matched, count(*) FILTER (l.doc_id IS NULL) AS missing, count(*) FILTER (d.doc_id IS NULL) AS unused FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
both("jon03_triplets", "SELECT o.o_orderkey, c.c_name, p.p_name FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey AND l.l_linenumber = 1 JOIN {part} p ON p.p_partkey = l.l_partkey WHERE p.p_name <> '' AND o.o_totalprice > 300000")
both("jon04_left_keep_empty", "SELECT c.c_custkey, count(o.o_orderkey) AS orders FROM {customer} c LEFT JOIN {orders} o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey")
both("jon05_semi", "SELECT doc_id FROM {documents} WHERE doc_id IN (SELECT doc_id FROM {labels} WHERE quality = 1)")
both("jon06_anti", "SELECT d.doc_id FROM {documents} d WHERE NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.doc_id)")
both("jon07_fresh_shards", "SELECT DISTINCT source, doc_id % 8 AS shard FROM {documents} a WHERE NOT EXISTS (SELECT 1 FROM {documents} b WHERE b.source = a.source AND b.doc_id % 8 = a.doc_id % 8 AND b.n_chars > 9000)")
both("jon08_missing_files", "SELECT p_partkey FROM {part} EXCEPT SELECT l_partkey FROM {lineitem} WHERE l_quantity > 45")
add("jon09_theta_boxes", lambda s, d: overlapping_boxes(read(s, d, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("box"), F.pmod("l_suppkey", F.lit(3)).alias("class"), F.col("l_quantity").alias("x"), F.pmod("l_partkey", F.lit(40)).alias("y")), 20.0, 0.05),
    "WITH b AS (SELECT l_orderkey AS image, l_linenumber AS box, l_suppkey % 3 AS class, l_quantity AS x, l_partkey % 40 AS y, 20e0 AS w FROM {lineitem}), o AS (SELECT a.image, a.box AS box_a, c.box AS box_b, greatest(0e0, least(a.x, c.x) + 20e0 - greatest(a.x, c.x)) * greatest(0e0, least(a.y, c.y) + 20e0 - greatest(a.y, c.y)) AS inter FROM b a JOIN b c ON a.image = c.image AND a.class = c.class AND a.box < c.box) SELECT image, box_a, box_b, round(inter / (800e0 - inter), 6) AS iou FROM o WHERE inter / (800e0 - inter) >= 0.05e0")
add("jon10_similarity_join", lambda s, d: similar_pairs(read(s, d, "embeddings"), 0.3),
    "SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(list_sum([CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE) FOR i IN range(1, 65)]), 5) AS dot FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE round(list_sum([CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE) FOR i IN range(1, 65)]), 5) > 0.3")
both("jon12_panel_responses", "SELECT u.conv_id, u.turn, coalesce(a.text, '') AS response FROM {conversations} u LEFT JOIN {conversations} a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'")
both("jon13_reports_metrics", "WITH m AS (SELECT user_id, max(event_id) AS step, CAST(count(*) AS BIGINT) AS n FROM {events} GROUP BY user_id) SELECT m.user_id, m.step, m.n, e.event_type FROM m JOIN {events} e ON e.event_id = m.step")
both("jon14_loss_cells", "WITH cells AS (SELECT source AS task, lang AS domain, CAST(count(*) AS BIGINT) AS cell FROM {documents} WHERE lang = 'en' GROUP BY source, lang), tasks AS (SELECT source AS task, CAST(-1 AS BIGINT) AS cell FROM {documents} GROUP BY source) SELECT d.doc_id, coalesce(c.cell, t.cell) AS cell FROM {documents} d LEFT JOIN cells c ON c.task = d.source AND c.domain = d.lang LEFT JOIN tasks t ON t.task = d.source")
add("jon15_order_equality", lambda s, d: numbered(read(s, d, "pages").select("page_id", "url"), "url", out="a").join(numbered(read(s, d, "pages").select(F.col("page_id").alias("other")), "other", out="b"), F.expr("a = b")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("page_id") != F.col("other"), 1).otherwise(0)).alias("misplaced")), "WITH a AS (SELECT page_id, row_number() OVER (ORDER BY url) AS r FROM pages), b AS (SELECT page_id, row_number() OVER (ORDER BY page_id) AS r FROM pages) SELECT count(*) AS n, CAST(sum(CASE WHEN a.page_id <> b.page_id THEN 1 ELSE 0 END) AS BIGINT) AS misplaced FROM a JOIN b ON a.r = b.r")

# ---- aggregates ----------------------------------------------------------------------------------------------------

both("agg05_tokens_by_key", f"WITH {EX} SELECT task || ':' || mode AS loss_key, CAST(sum(n_chars) AS BIGINT) AS tokens FROM ex GROUP BY task || ':' || mode")
add("agg06_loss_weights", lambda s, d: measures.loss_weights(read(s, d, "documents").withColumnRenamed("source", "task"), "task", "n_chars").select("task", "tokens", F.round("weight", 6).alias("weight")), f"WITH {EX}, t AS (SELECT task, CAST(sum(n_chars) AS BIGINT) AS tokens FROM ex GROUP BY task) SELECT task, tokens, round((1e0 / count(*) OVER ()) / (tokens / sum(tokens) OVER ()), 6) AS weight FROM t")
both("agg08_expert_shares", "WITH c AS (SELECT l_suppkey % 16 AS expert, count(*) AS n FROM {lineitem} WHERE l_suppkey % 16 <> 5 GROUP BY 1), e AS (SELECT s_suppkey - 1 AS expert FROM {supplier} WHERE s_suppkey <= 16) SELECT e.expert, coalesce(c.n, 0) AS n, round(coalesce(c.n, 0) / sum(c.n) OVER (), 9) AS share, coalesce(c.n, 0) = 0 AS dead FROM e LEFT JOIN c ON c.expert = e.expert")
both("agg09_finite_means", "SELECT l_returnflag, round(avg(CASE WHEN l_quantity <> 13 THEN l_tax END), 9) AS mean, round(sqrt(sum(l_discount * l_discount)), 6) AS norm FROM {lineitem} GROUP BY l_returnflag")
_P = "p AS (SELECT l_orderkey AS id, l_suppkey % 7 AS label, CASE WHEN l_partkey % 3 = 0 THEN l_partkey % 7 ELSE l_suppkey % 7 END AS pred, l_linenumber AS subject, l_tax * 10e0 AS conf FROM {lineitem})"
both("agg10_confusion_accuracy", f"WITH {_P}, c AS (SELECT label, avg(CASE WHEN pred = label THEN 1e0 ELSE 0e0 END) AS acc, count(*) AS n, sum(CASE WHEN pred = label THEN 1 ELSE 0 END) AS hit FROM p GROUP BY label) SELECT round(sum(hit) / sum(n), 9) AS top1, round(avg(acc), 9) AS macro FROM c")
both("agg11_accuracy_by_subject", f"WITH {_P} SELECT subject, label, round(avg(CASE WHEN pred = label THEN 1e0 ELSE 0e0 END), 9) AS acc, count(*) AS n FROM p GROUP BY GROUPING SETS ((subject, label), (subject), ())")
both("agg12_accuracy_by_category", f"WITH {_P} SELECT CASE WHEN subject IN (1, 2) THEN 'default' ELSE 'cat' || CAST(subject AS STR) END AS category, count(*) AS n, CAST(sum(CASE WHEN pred = label THEN 1 ELSE 0 END) AS BIGINT) AS correct FROM p GROUP BY ROLLUP (CASE WHEN subject IN (1, 2) THEN 'default' ELSE 'cat' || CAST(subject AS STR) END)")
add("agg13_choice_accuracy", lambda s, d: measures.choice_accuracy(read(s, d, "lineitem"), "l_orderkey", "l_linenumber", 1 + F.pmod("l_orderkey", F.lit(3)), acc=F.col("l_extendedprice"), acc_norm=F.col("l_extendedprice") / F.col("l_quantity")).select(F.round("acc", 9).alias("acc"), F.round("acc_norm", 9).alias("acc_norm")), "WITH c AS (SELECT l_orderkey AS ex, l_linenumber AS choice, l_extendedprice AS score, l_extendedprice / l_quantity AS norm FROM {lineitem}), r AS (SELECT ex, choice, row_number() OVER (PARTITION BY ex ORDER BY score DESC, choice) AS a, row_number() OVER (PARTITION BY ex ORDER BY norm DESC, choice) AS b FROM c) SELECT round(avg(CASE WHEN a = 1 THEN CASE WHEN choice = 1 + ex % 3 THEN 1e0 ELSE 0e0 END END), 9) AS acc, round(avg(CASE WHEN b = 1 THEN CASE WHEN choice = 1 + ex % 3 THEN 1e0 ELSE 0e0 END END), 9) AS acc_norm FROM r")
both("agg14_mean_of_benchmarks", f"WITH {_P}, c AS (SELECT subject, avg(CASE WHEN pred = label THEN 1e0 ELSE 0e0 END) AS acc FROM p GROUP BY subject) SELECT round(avg(acc), 9) AS mean FROM c")
both("agg15_token_accuracy", "SELECT round(avg(CASE WHEN l_partkey % 5 = l_suppkey % 5 THEN 1e0 ELSE 0e0 END), 9) AS acc, count(*) AS n FROM {lineitem} WHERE CASE WHEN l_linenumber = 3 THEN -100 ELSE l_linenumber END <> -100")
both("agg16_perplexity", "SELECT l_returnflag, round(exp(sum(l_tax * l_quantity) / sum(l_quantity)), 6) AS ppl FROM {lineitem} GROUP BY l_returnflag")
add("agg17_calibration_error", lambda s, d: calibration_error(read(s, d, "lineitem").select((F.col("l_discount") * 9.7).alias("c"), (F.pmod("l_partkey", F.lit(3)) == 0).alias("ok")), "c", "ok"), "WITH b AS (SELECT ceil(l_discount * 9.7::DOUBLE * 10) AS bin, count(*) AS n, avg(l_discount * 9.7::DOUBLE) AS c, avg(CASE WHEN l_partkey % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS a FROM lineitem WHERE l_discount * 9.7::DOUBLE > 0 GROUP BY 1) SELECT round(sum(n / (SELECT count(*) FROM lineitem) * abs(a - c)), 6) AS error FROM b")
both("agg18_run_summary", "SELECT user_id, round(median(CASE WHEN event_id > 100 THEN value END), 6) AS throughput, min(value) AS best, max(event_id) AS final_step FROM {events} GROUP BY user_id")
both("agg19_subject_gate", f"WITH {_P}, u AS (SELECT subject, avg(CASE WHEN pred = label THEN 1e0 ELSE 0e0 END) AS acc FROM p GROUP BY subject) SELECT count(*) AS folds, round(avg(acc), 9) AS mean, round(min(acc), 9) AS worst, min(acc) >= 0.5e0 AND count(*) >= 3 AS passed FROM u")
both("agg20_fold_coverage", f"WITH {_P}, f AS (SELECT DISTINCT subject FROM p), k AS (SELECT DISTINCT label FROM p), n AS (SELECT subject, label, count(*) AS n FROM p WHERE id % 11 <> 0 GROUP BY subject, label) SELECT f.subject, min(coalesce(n.n, 0)) AS low, max(coalesce(n.n, 0)) AS high, CAST(sum(CASE WHEN n.n IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing FROM f CROSS JOIN k LEFT JOIN n ON n.subject = f.subject AND n.label = k.label GROUP BY f.subject")
both("agg21_bucket_counts", "WITH d AS (SELECT l_orderkey, count(*) AS k FROM {lineitem} GROUP BY l_orderkey) SELECT l_suppkey % 5 AS class, CASE WHEN l_quantity < 16 THEN 0 WHEN l_quantity < 32 THEN 1 ELSE 2 END AS size, CASE WHEN k <= 3 THEN 0 WHEN k <= 5 THEN 1 ELSE 2 END AS density, count(*) AS n FROM {lineitem} l JOIN d ON d.l_orderkey = l.l_orderkey GROUP BY 1, 2, 3")
_C = "c AS (SELECT c_nationkey AS class, count(*) AS n FROM {customer} GROUP BY c_nationkey)"
add("agg22_effective_number", lambda s, d: effective_number_weights(read(s, d, "customer").groupBy(F.col("c_nationkey").alias("class")).agg(F.count("*").alias("n"))).select("class", "n", F.round("weight", 6).alias("weight")), f"WITH {_C}, r AS (SELECT class, n, (1 - 0.999::DOUBLE) / (1 - pow(0.999::DOUBLE, n)) AS raw FROM c) SELECT class, n, round(least(4.0::DOUBLE, greatest(0.25::DOUBLE, raw / avg(raw) OVER ())), 6) AS weight FROM r")
add("agg23_class_weights", lambda s, d: weights_from_counts(read(s, d, "customer").groupBy(F.col("c_nationkey").alias("class")).agg(F.count("*").alias("n"))).select("class", F.round("weight", 6).alias("weight")), f"WITH {_C} SELECT class, round((1 / sqrt(n)) / avg(1 / sqrt(n)) OVER (), 6) AS weight FROM c")
add("agg24_bounded_weights", lambda s, d: bounded_mean_one(weights_from_counts(read(s, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n")), mode="inverse"), 0.5, 1.5).select("c_nationkey", "c_mktsegment", F.round("bounded", 4).alias("bounded")))
add("agg25_sqrt_mixture", lambda s, d: measures.power_mixture(read(s, d, "documents"), "source").select("source", F.round("weight", 9).alias("weight")), "SELECT source, round(sqrt(count(*)) / sum(sqrt(count(*))) OVER (), 9) AS weight FROM {documents} GROUP BY source")
add("agg27_exact_match", lambda s, d: measures.exact_match(measures.following(read(s, d, "conversations"), "role", "conv_id", "turn", value="text"), "role", "text", "before").withColumn("rate", F.round("rate", 9)), "SELECT role, round(avg(CASE WHEN lower(trim(text)) = lower(trim(lag_text)) THEN 1e0 ELSE 0e0 END), 9) AS rate FROM (SELECT role, text, coalesce(lag(text) OVER (PARTITION BY role ORDER BY conv_id, turn), '') AS lag_text FROM {conversations}) x GROUP BY role")
add("agg28_assignment_shares", lambda s, d: measures.shares(_routed(s, d), "layer", "expert").select("layer", "expert", "n", F.round("share", 9).alias("share")), "SELECT l_linenumber AS layer, l_suppkey % 8 AS expert, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY l_linenumber), 9) AS share FROM {lineitem} GROUP BY l_linenumber, l_suppkey % 8")
add("agg29_routing_entropy", lambda s, d: measures.routing_entropy(_routed(s, d), "layer", "expert", 8).select("layer", F.round("entropy", 9).alias("entropy")), "WITH s AS (SELECT l_linenumber AS layer, l_suppkey % 8 AS expert, count(*) AS n FROM {lineitem} GROUP BY 1, 2), t AS (SELECT layer, n / CAST(sum(n) OVER (PARTITION BY layer) AS DOUBLE) AS p FROM s) SELECT layer, round(-sum(p * ln(p)) / ln(8e0), 9) AS entropy FROM t GROUP BY layer")
add("agg32_group_advantage", lambda s, d: measures.group_advantage(read(s, d, "lineitem"), "l_orderkey", "l_quantity").select("l_orderkey", "l_linenumber", F.round("advantage", 5).alias("advantage")), "WITH g AS (SELECT l_orderkey, l_linenumber, l_quantity - avg(l_quantity) OVER (PARTITION BY l_orderkey) AS diff, stddev_samp(l_quantity) OVER (PARTITION BY l_orderkey) AS sd FROM {lineitem}) SELECT l_orderkey, l_linenumber, round(diff / (sd + 1e-8), 5) AS advantage FROM g WHERE sd >= 1e-8")
both("agg33_serving_stats", "SELECT count(*) AS n, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS pending, CAST(sum(CASE WHEN event_type IN ('purchase', 'signup', 'logout') THEN 1 ELSE 0 END) AS BIGINT) AS completed, round(avg(CASE WHEN event_type = 'purchase' THEN value END), 6) AS latency FROM {events}")
add("agg34_recall_metrics", lambda s, d: measures.recall_metrics(read(s, d, "lineitem").withColumn("first", F.min("l_linenumber").over(Window.partitionBy("l_orderkey"))), "l_orderkey", F.col("l_quantity") / 10.0, F.col("l_linenumber") == F.col("first")).select(F.round("acc", 9).alias("acc"), *[F.round(c, 6).alias(c) for c in ("mean_rank", "margin", "nll")]), "WITH l AS (SELECT l_orderkey AS row_id, l_linenumber AS token, l_quantity / 10e0 AS logit, min(l_linenumber) OVER (PARTITION BY l_orderkey) AS target FROM {lineitem}), t AS (SELECT row_id, max(CASE WHEN token = target THEN logit END) AS want, max(CASE WHEN token <> target THEN logit END) AS best, max(logit) AS top, ln(sum(exp(logit))) AS lse FROM l GROUP BY row_id), k AS (SELECT l.row_id, sum(CASE WHEN l.logit > t.want THEN 1 ELSE 0 END) AS above FROM l JOIN t ON t.row_id = l.row_id GROUP BY l.row_id) SELECT round(avg(CASE WHEN above = 0 THEN 1e0 ELSE 0e0 END), 9) AS acc, round(avg(1e0 + above), 6) AS mean_rank, round(avg(want - best), 6) AS margin, round(avg(lse - want), 6) AS nll FROM t JOIN k ON k.row_id = t.row_id")
add("agg36_info_nce", lambda s, d: measures.info_nce(read(s, d, "lineitem"), "l_orderkey", F.col("l_discount") * 20.0, F.col("l_linenumber") == 1).select(F.round("loss", 6).alias("loss")), "WITH l AS (SELECT l_orderkey AS q, l_linenumber AS j, l_discount * 20e0 AS s FROM {lineitem}), t AS (SELECT q, max(CASE WHEN j = 1 THEN s END) AS pos, ln(sum(exp(s))) AS lse FROM l GROUP BY q) SELECT round(avg(lse - pos), 6) AS loss FROM t WHERE pos IS NOT NULL")
add("agg38_topk_accuracy", lambda s, d: measures.top_k_accuracy(read(s, d, "lineitem").withColumn("modality", F.pmod("l_suppkey", F.lit(3))), "l_orderkey", "l_extendedprice", "l_linenumber", "modality", 1, 5).select("modality", F.round("top1", 9).alias("top1"), F.round("top5", 9).alias("top5")), "WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey % 3 AS modality, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM {lineitem}) SELECT modality, round(avg(CASE WHEN r = 1 THEN 1e0 ELSE 0e0 END), 9) AS top1, round(avg(CASE WHEN r <= 5 THEN 1e0 ELSE 0e0 END), 9) AS top5 FROM r GROUP BY modality")
add("agg39_latency_summary", lambda s, d: nearest_rank(read(s, d, "events"), "value", {"p50": 0.5, "p95": 0.95}, "event_id").crossJoin(read(s, d, "events").agg(F.round(F.avg("value"), 6).alias("mean"))), "WITH o AS (SELECT value, row_number() OVER (ORDER BY value, event_id) AS r, count(*) OVER () AS n FROM events) SELECT round(avg(value), 6) AS mean, max(CASE WHEN r = floor((n - 1) * 0.5e0 + 0.5e0) + 1 THEN value END) AS p50, max(CASE WHEN r = floor((n - 1) * 0.95e0 + 0.5e0) + 1 THEN value END) AS p95 FROM o")
add("agg40_profiler_summary", lambda s, d: measures.profile(read(s, d, "events"), "event_type", "value", "event_id", p50=0.5, p90=0.9, p99=0.99).withColumn("sd", F.round("sd", 6)), "WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM {events}) SELECT event_type, max(CASE WHEN r = floor(n / 2e0) THEN value END) AS p50, max(CASE WHEN r = floor(n * 0.9e0) THEN value END) AS p90, max(CASE WHEN r = floor(n * 0.99e0) THEN value END) AS p99, round(stddev_samp(value), 6) AS sd FROM o GROUP BY event_type")

# ---- windows and rankings ------------------------------------------------------------------------------------------

both("win01_stable_order", "SELECT doc_id, SHA('42:' || CAST(doc_id AS STR)) AS place FROM {documents}")
add("win02_surface_cap", lambda s, d: surface_cap(read(s, d, "documents").select("doc_id", "source", F.substring("text", 1, 1).alias("opening")), "source", "doc_id", "opening", 2).select("doc_id"), "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source, substr(text, 1, 1) ORDER BY sha256('42:' || CAST(doc_id AS VARCHAR))) AS r FROM documents) WHERE r <= 2")
add("win03_round_robin", lambda s, d: balance(read(s, d, "documents").select("doc_id", "source"), "source", "doc_id", 90), "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('42:' || CAST(doc_id AS VARCHAR))) AS r FROM documents) ORDER BY r, source LIMIT 90")
add("win04_weighted_balance", lambda s, d: weighted_balance(read(s, d, "documents").select("doc_id", "lang"), "lang", "doc_id", {"en": 0.4, "fr": 0.3, "de": 0.2, "es": 0.1}, 60).groupBy("lang").count())
both("win05_plain_top", "SELECT doc_id FROM {documents} ORDER BY SHA('42:' || CAST(doc_id AS STR)) LIMIT 40")
add("win06_curriculum", lambda s, d: (lambda rows: curriculum_stage(rows, curriculum_stage(rows.where("source < 'src5'"), None, "source", "doc_id", 30), "source", "doc_id", 80).select("doc_id"))(read(s, d, "documents").select("doc_id", "source")), "WITH o AS (SELECT doc_id, source, sha256('42:' || CAST(doc_id AS VARCHAR)) AS h FROM documents), a AS (SELECT doc_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY h) AS r FROM o WHERE source < 'src5') ORDER BY r, source LIMIT 30), b AS (SELECT doc_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY h) AS r FROM o WHERE doc_id NOT IN (SELECT doc_id FROM a)) ORDER BY r, source LIMIT 50) SELECT doc_id FROM a UNION ALL SELECT doc_id FROM b")
both("win07_first_argmax", "SELECT l_orderkey, CAST(l_linenumber AS INT) AS choice FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS r FROM {lineitem}) x WHERE r = 1")
both("win08_promotion", "SELECT s_suppkey, s_acctbal FROM {supplier} WHERE s_acctbal > 0 ORDER BY s_nationkey DESC, s_acctbal DESC, s_suppkey LIMIT 1")
add("win16_retrieval_rank", lambda s, d: measures.retrieval(read(s, d, "lineitem"), "l_orderkey", "l_extendedprice", F.col("l_linenumber") == 1).select(F.round("acc1", 9).alias("acc1"), F.round("mrr", 9).alias("mrr")), "WITH s AS (SELECT a.l_orderkey AS q, a.l_linenumber AS j, rank() OVER (PARTITION BY a.l_orderkey ORDER BY a.l_extendedprice DESC) AS r FROM {lineitem} a) SELECT round(avg(CASE WHEN r = 1 THEN 1e0 ELSE 0e0 END), 9) AS acc1, round(avg(1e0 / r), 9) AS mrr FROM s WHERE j = 1")
both("win18_rolling_throughput", "SELECT event_id, user_id, round(100e0 / avg(value + 1) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 6) AS throughput FROM {events}")
both("win19_early_stop", "WITH m AS (SELECT user_id, event_id, ts, value, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM {events}), b AS (SELECT *, CASE WHEN best IS NULL OR value < best THEN 1 ELSE 0 END AS better FROM m), g AS (SELECT *, sum(better) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM b) SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) - 1 AS INT) AS stale FROM g")
add("win21_nucleus", lambda s, d: measures.nucleus(read(s, d, "lineitem"), "l_orderkey", "l_linenumber", F.col("l_quantity") / 10.0, 0.9).select("l_orderkey", "l_linenumber", F.round("p", 6).alias("p")), "WITH p AS (SELECT l_orderkey, l_linenumber, exp(l_quantity / 10e0) / sum(exp(l_quantity / 10e0)) OVER (PARTITION BY l_orderkey) AS p FROM {lineitem}), c AS (SELECT *, sum(p) OVER (PARTITION BY l_orderkey ORDER BY p DESC, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - p AS before FROM p) SELECT l_orderkey, l_linenumber, round(p, 6) AS p FROM c WHERE before < 0.9e0 - 1e-9")
add("win22_banned_next", lambda s, d: measures.banned_next(read(s, d, "events"), "user_id", ["ts", "event_id"], "event_type"), "WITH t AS (SELECT user_id, event_type AS x, lead(event_type) OVER w AS y, lead(event_type, 2) OVER w AS z, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), last AS (SELECT user_id, max(CASE WHEN back = 2 THEN x END) AS a, max(CASE WHEN back = 1 THEN x END) AS b FROM t GROUP BY user_id) SELECT DISTINCT t.user_id, t.z AS banned FROM t JOIN last ON last.user_id = t.user_id AND t.x = last.a AND t.y = last.b WHERE t.z IS NOT NULL")
both("win29_latest_checkpoint", "SELECT o_custkey, max(o_orderkey) AS step FROM {orders} WHERE o_orderstatus = 'F' GROUP BY o_custkey")
both("win30_latest_step", "SELECT o_custkey, step FROM (SELECT o_custkey, CASE WHEN o_orderstatus = 'O' THEN o_orderkey + 7 ELSE o_orderkey END AS step, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM {orders}) x WHERE r = 1")

# ---- sorts, samples, sets ------------------------------------------------------------------------------------------

add("srt01_shuffle", lambda s, d: read(s, d, "documents").select("doc_id", F.xxhash64(F.lit(42), "doc_id").alias("place")).orderBy("place"))
add("srt02_hash_split", lambda s, d: hash_split(read(s, d, "documents").select("doc_id"), "doc_id", 0.1), "SELECT doc_id, row_number() OVER (ORDER BY sha256('42:' || CAST(doc_id AS VARCHAR))) > CAST(floor(count(*) OVER () * (1 - 0.1::DOUBLE)) AS BIGINT) AS held FROM documents")
both("srt04_block_shuffle", "SELECT doc_id, CAST(floor(doc_id / 100) AS BIGINT) AS block, SHA('7:' || CAST(doc_id AS STR)) AS place FROM {documents}")
both("srt05_copy_n", "SELECT doc_id FROM {documents} WHERE source = 'src1' ORDER BY SHA('5:' || CAST(doc_id AS STR)) LIMIT 5")
add("srt06_with_replacement", lambda s, d: with_replacement(read(s, d, "documents").select("doc_id"), "doc_id", 500).select("doc_id", "draws"))
add("srt07_epoch_order", lambda s, d: s.range(3).withColumnRenamed("id", "epoch").crossJoin(read(s, d, "benchmark").select("item_id")).select("epoch", "item_id", F.xxhash64("epoch", "item_id").alias("place")))
both("srt08_stratified", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY SHA('8:' || CAST(doc_id AS STR))) AS r FROM {documents}) x WHERE r <= 10")
both("srt09_pad_to_batches", "SELECT rnk, n, CAST(floor((n + 7) / 8) * 8 - n AS BIGINT) AS padding FROM (SELECT doc_id % 4 AS rnk, count(*) AS n FROM {documents} GROUP BY 1) x")
both("srt10_rank_slices", "SELECT doc_id FROM {documents} WHERE doc_id % 4 = 2")
both("srt12_smallest_bucket", "SELECT p_partkey, CAST(capacity AS INT) AS capacity FROM (SELECT p_partkey, capacity, row_number() OVER (PARTITION BY p_partkey ORDER BY capacity) AS r FROM {part} JOIN (SELECT 10 * (1 + n_nationkey) AS capacity FROM {nation}) b ON capacity >= p_size) x WHERE r = 1")
add("srt13_lru_eviction", lambda s, d: running_total(read(s, d, "pages").select("page_id", F.length("html").alias("bytes"), (-F.col("page_id")).alias("o")).withColumn("k", F.lit(0)), ["k"], "o", "bytes").where(F.col("before") + F.col("bytes") > 100_000).select("page_id"), "WITH o AS (SELECT page_id, length(html) AS bytes, row_number() OVER (ORDER BY page_id DESC) AS recency FROM pages), k AS (SELECT page_id, sum(bytes) OVER (ORDER BY recency) AS used FROM o) SELECT page_id FROM k WHERE used > 100000")
add("src13_cache_budget", lambda s, d: running_total(read(s, d, "pages").select("page_id", F.length("html").alias("bytes"), (-F.col("page_id")).alias("o")).withColumn("k", F.lit(0)), ["k"], "o", "bytes").select("page_id", (F.col("before") + F.col("bytes")).alias("used")), "SELECT page_id, CAST(sum(length(html)) OVER (ORDER BY page_id DESC) AS BIGINT) AS used FROM pages")
both("src32_min_length_sample", "SELECT doc_id, n_chars FROM {documents} WHERE n_chars >= 200 ORDER BY doc_id LIMIT 30")
both("src33_success_guard", "SELECT lang, doc_id % 5 AS batch, avg(CASE WHEN n_chars > 800 THEN 1e0 ELSE 0e0 END) < 0.25e0 AS stop FROM {documents} GROUP BY lang, doc_id % 5")
both("set01_union_all", "SELECT 'customer' AS kind, c_custkey AS id, c_name AS name FROM {customer} UNION ALL SELECT 'supplier', s_suppkey, s_name FROM {supplier} UNION ALL SELECT 'part', p_partkey, p_name FROM {part}")
both("set02_intersect_all", "SELECT l_partkey FROM {lineitem} WHERE l_returnflag = 'R' INTERSECT ALL SELECT l_partkey FROM {lineitem} WHERE l_returnflag = 'A'")
both("set03_intersect", "SELECT c_nationkey FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}")
both("set04_differences", "SELECT 'missing' AS kind, doc_id FROM (SELECT doc_id FROM {documents} EXCEPT SELECT doc_id FROM {labels}) a UNION ALL SELECT 'unused', doc_id FROM (SELECT doc_id FROM {labels} EXCEPT SELECT doc_id FROM {documents}) b")
both("set05_distinct", "SELECT count(DISTINCT p_name) AS names, count(DISTINCT p_brand) AS brands FROM {part}")

# ---- filters and guards --------------------------------------------------------------------------------------------

both("flt01_filter", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice > 200000 AND o_orderpriority = '1-URGENT'")
both("flt02_map", "SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS BIGINT) AS charge FROM {lineitem}")
both("flt11_label_stats", "SELECT l_orderkey, count(CASE WHEN l_linenumber <> 2 THEN 1 END) AS supervised, coalesce(min(CASE WHEN l_linenumber <> 2 THEN l_linenumber END), -1) AS low, coalesce(max(CASE WHEN l_linenumber <> 2 THEN l_linenumber END), -1) AS high FROM {lineitem} GROUP BY l_orderkey")
both("flt12_coverage_guard", "SELECT e / CAST(greatest(1, t) AS DOUBLE) >= 0.05e0 AS enough FROM (SELECT count(CASE WHEN doc_id % 10 = 0 THEN 1 END) AS e, count(CASE WHEN doc_id % 10 <> 0 THEN 1 END) AS t FROM {documents}) x")
both("flt13_stride_hold_out", "SELECT doc_id FROM {documents} WHERE doc_id % 10 <> 0")
both("flt14_clip_boxes", "WITH b AS (SELECT l_orderkey, l_linenumber, greatest(0e0, l_quantity - 10) AS x1, least(40e0, l_quantity + 5) AS x2, greatest(0e0, l_partkey % 50 - 10e0) AS y1, least(40e0, l_partkey % 50 + 5e0) AS y2 FROM {lineitem}) SELECT l_orderkey, l_linenumber, round((x1 + x2) / 80, 6) AS cx, round((y1 + y2) / 80, 6) AS cy, round((x2 - x1) / 40, 6) AS w, round((y2 - y1) / 40, 6) AS h FROM b WHERE x2 > x1 AND y2 > y1")
both("flt15_crop_boxes", "WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, 12e0 AS w, greatest(0e0, least(l_quantity + 12, 45e0) - greatest(l_quantity, 15e0)) AS seen FROM {lineitem}) SELECT l_orderkey, l_linenumber, round(seen / w, 6) AS visible FROM b WHERE seen >= 2 AND seen / w >= 0.2e0")
both("flt18_mosaic", "SELECT l_orderkey, l_linenumber, l_linenumber % 2 AS col, CAST(floor(l_linenumber / 2) AS INT) AS row_no, round((l_linenumber % 2 + l_tax) / 2, 6) AS cx FROM {lineitem} WHERE l_linenumber <= 4")
both("mth05_finite_parse", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'x' ELSE CAST(event_id AS STR) END AS DOUBLE) AS v FROM {events}")
both("dat01_dates", "SELECT o_orderkey, CAST(dayofmonth(o_orderdate) AS BIGINT) AS day, CAST(dayofyear(o_orderdate) AS BIGINT) AS doy, CAST(CAST(o_orderdate AS DATE) + INTERVAL 10 DAY AS DATE) AS later FROM {orders}")
both("mth04_cosine_schedule", "SELECT p_partkey, round(0.5e0 * (1 + cos(pi() * p_size / 50e0)), 9) AS rate FROM {part}")
add("mth03_softmax", lambda s, d: measures.softmax(read(s, d, "lineitem"), "l_orderkey", F.col("l_quantity")).select("l_orderkey", "l_linenumber", F.round("p", 9).alias("p")), "SELECT l_orderkey, l_linenumber, round(exp(l_quantity - max(l_quantity) OVER w) / sum(exp(l_quantity - 50e0)) OVER w * exp(max(l_quantity) OVER w - 50e0), 9) AS p FROM {lineitem} WINDOW w AS (PARTITION BY l_orderkey)")

# ---- artifacts and gates -------------------------------------------------------------------------------------------

both("snk10_config_diff", "WITH a AS (SELECT n_name AS k, CAST(n_regionkey AS STR) AS v FROM {nation} WHERE n_nationkey < 20), b AS (SELECT n_name AS k, CAST(CASE WHEN n_nationkey % 6 = 0 THEN 9 ELSE n_regionkey END AS STR) AS v FROM {nation} WHERE n_nationkey > 3) SELECT coalesce(a.k, b.k) AS k, a.v AS was, b.v AS is_now FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v")
both("snk15_supervision", "SELECT l_orderkey, CASE WHEN count(*) = 0 THEN 'empty' WHEN sum(l_quantity) < 50 THEN 'too little' ELSE 'ok' END AS contract FROM {lineitem} GROUP BY l_orderkey")
both("snk18_retention", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM {orders} WHERE o_orderstatus <> 'P') x WHERE r > 3")
both("snk19_cleanup_plan", "SELECT url FROM {pages} WHERE url LIKE 'http%' AND (SELECT count(*) FROM {pages} WHERE url = '') = 0")
both("met21_ablation_deltas", "SELECT lang, round(avg(n_chars) - max(base), 6) AS delta FROM (SELECT lang, n_chars, (SELECT avg(n_chars) FROM {documents} WHERE lang = 'en') AS base FROM {documents}) x GROUP BY lang")
add("win12_average_precision", lambda s, d: (lambda l: measures.class_precision(l, "class", "l_extendedprice", ("l_orderkey", "l_linenumber"), F.col("tp")).select("class", F.round("ap", 9).alias("ap")))(_classes(s, d)), "WITH o AS (SELECT l_suppkey % 4 AS class, row_number() OVER (PARTITION BY l_suppkey % 4 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r, CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END AS tp FROM {lineitem}), c AS (SELECT class, r, tp, sum(tp) OVER (PARTITION BY class ORDER BY r) AS hits, sum(tp) OVER (PARTITION BY class) AS total FROM o), e AS (SELECT class, tp, total, max(hits / CAST(r AS DOUBLE)) OVER (PARTITION BY class ORDER BY r DESC) AS envelope FROM c) SELECT class, round(sum(tp * envelope) / max(total), 9) AS ap FROM e GROUP BY class")
add("win13_best_f1", lambda s, d: (lambda l: measures.class_best_f1(l, "class", "l_extendedprice", ("l_orderkey", "l_linenumber"), F.col("tp")).select("class", F.round("f1", 9).alias("f1")))(_classes(s, d)), "WITH o AS (SELECT l_suppkey % 4 AS class, row_number() OVER (PARTITION BY l_suppkey % 4 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r, CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END AS tp FROM {lineitem}), c AS (SELECT class, r, sum(tp) OVER (PARTITION BY class ORDER BY r) AS hits, sum(tp) OVER (PARTITION BY class) AS total FROM o) SELECT class, round(max(2e0 * hits / (r + total)), 9) AS f1 FROM c GROUP BY class")
both("mth02_iou", "SELECT l_orderkey, l_linenumber, round(greatest(0e0, 10 - abs(l_quantity - 20)) * 10 / (200 - greatest(0e0, 10 - abs(l_quantity - 20)) * 10), 9) AS iou FROM {lineitem}")

# ---- extensions ----------------------------------------------------------------------------------------------------

both("ext_exact_duplicates", "SELECT min(doc_id) AS keeper, count(*) AS copies FROM {documents} GROUP BY text HAVING count(*) > 1")
both("ext_tumbling_window", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM {events} GROUP BY 1, 2")

QUERIES, ORACLES = BOOK.queries, BOOK.oracles
