"""Registered queries over whole tables.  Some twins still read a part of their table; here they run with that bound lifted."""

import collections

import pytest
from pyspark.sql import functions as F

from granary import catalog
from granary.functions import text as T
from granary.operators import detection, relational, series

from . import oracle

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


def whole(name, *bounds):
    """The twin's text without the given bounds."""
    sql = ORACLES[name]
    for bound, by in bounds:
        sql = sql.replace(bound, by)
    return sql


def same(spark, name, sql, sf="sf0.01"):
    path = f"/root/testdata/{sf}"
    assert oracle.difference(spark, QUERIES[name], sql, path, oracle.connect(path)) is None


def test_similarity_join_compares_all_vectors(spark, monkeypatch):
    monkeypatch.setattr(relational, "TOGETHER", 20)
    same(spark, "jon10_similarity_join", whole("jon10_similarity_join", ("a.vec_id % 4 = 0 AND b.vec_id % 4 = 0 AND ", "")), "sf0.001")


def test_theta_boxes_of_all_images(spark):
    same(spark, "jon09_theta_boxes", whole("jon09_theta_boxes", (" WHERE l_orderkey <= 4000", "")))


@pytest.mark.parametrize("name", ["win14_greedy_matching", "win15_suppression", "met18_scores_by_image"])
def test_detection_meets_all_images(spark, name):
    path = "/root/testdata/sf0.01"
    images = QUERIES[name](spark, path).select("image").distinct().count()
    assert images == spark.read.parquet(f"{path}/lineitem.parquet").select("l_orderkey").distinct().count()


def test_detection_scores_count_all_boxes(spark):
    path = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{path}/lineitem.parquet").count()
    assert sum(r.predictions for r in QUERIES["agg35_partial_state"](spark, path).collect()) == rows
    got = QUERIES["met17_detection_scores"](spark, path).first()
    bounded = detection.detection_scores(*[detection._boxes(spark, path, shift).where("image <= 3000") for shift in (3.0, 0.0)]).first()
    assert got != bounded and 0 < got.f1 <= 1


def test_states_of_parts_are_the_state_of_all_images(spark):
    """Merged states against scores counted at once by plain loops over matches, for classes and sizes."""
    path = "/root/testdata/sf0.001"
    left, right = detection._boxes(spark, path, 3.0), detection._boxes(spark, path)
    area = lambda r: max(0, r.x2 - r.x1) * max(0, r.y2 - r.y1) * 4.0
    size = lambda r: next(i for i, (_, lo, hi) in enumerate(detection.SIZES, 1) if lo <= area(r) < hi)

    def plain(p, t):
        counts = collections.Counter(r.label for r in t.collect())
        aps = collections.defaultdict(list)
        every = []
        matched = detection.match(p, t).collect()
        for label in counts:
            rows = sorted((r for r in matched if r.label == label), key=lambda r: (-r.score, r.image, r.box))
            every += rows
            for k in range(10):
                tp, precision = 0, []
                for n, r in enumerate(rows, 1):
                    tp += r.hits[k]
                    precision.append((tp / n, r.hits[k]))
                best, total = 0.0, 0.0
                for q, hit in reversed(precision):
                    best = max(best, q)
                    total += best * hit
                aps[k].append(total / counts[label])
        mean = [sum(v) / len(v) for v in aps.values()] or [0.0]
        every.sort(key=lambda r: (-r.score, r.label, r.image, r.box))
        tp, curve = 0, []
        for n, r in enumerate(every, 1):
            tp += r.hits[0]
            curve.append((2 * tp / (n + sum(counts.values())), -n, r.score))
        return mean[0], sum(mean) / len(mean), max(curve, default=(0.0, 0, 1.0))

    got = detection.detection_scores(left, right, image_size=2.0).first()
    ap50, ap, (f1, _, score) = plain(left, right)
    assert (got.ap50, got.ap, got.best_f1, got.best_confidence) == (pytest.approx(ap50, abs=2e-6), pytest.approx(ap, abs=2e-6), pytest.approx(f1, abs=2e-6), score)
    of = lambda df, i: spark.createDataFrame([r for r in df.collect() if size(r) == i], df.schema)
    for i, (name, _, _) in enumerate(detection.SIZES, 1):
        assert got[f"ap_{name}"] == pytest.approx(plain(of(left, i), of(right, i))[1], abs=2e-6), name
    whole_state = detection.partial_state(left, right)
    want = {(r.label, r.threshold): r.ap for r in detection.average_precision(whole_state).where("scope = 'all'").collect()}
    for r in QUERIES["agg35_partial_state"](spark, path).collect():
        assert r.ap == pytest.approx(sum(want[r.label, k] for k in range(10)) / 10, abs=2e-6)
        assert r.targets == right.where(F.col("label") == r.label).count() and r.matches <= r.predictions


def test_scores_without_boxes(spark):
    none = detection._boxes(spark, "/root/testdata/sf0.001").where("false")
    some = detection._boxes(spark, "/root/testdata/sf0.001").where("image < 20")
    empty = detection.detection_scores(none, none).first()
    assert (empty.ap, empty.f1, empty.best_f1, empty.best_confidence) == (0.0, 0.0, 0.0, 1.0)
    assert detection.detection_scores(none, some).first().ap == 0.0
    missed = detection.detection_scores(some, none).first()
    assert (missed.ap, missed.precision, missed.best_f1) == (0.0, 0.0, 0.0) and missed.best_confidence == some.agg(F.max("score")).first()[0]


@pytest.mark.parametrize(
    "name, bound", [("win24_resample", " WHERE user_id <= 20"), ("pck07_separators", " WHERE l_orderkey <= 2000"), ("src24_video_clips", " WHERE user_id <= 5"), ("src23_box_labels", " WHERE l_orderkey <= 500")]
)
def test_all_ids_have_results(spark, name, bound):
    same(spark, name, whole(name, (bound, "")))


def test_mixup_pairs_are_one_ring_of_all_items(spark):
    path = "/root/testdata/sf0.001"
    pairs = {r.item_id: r.partner for r in QUERIES["arr05_mixup_pairs"](spark, path).collect()}
    items = {r.item_id for r in spark.read.parquet(f"{path}/benchmark.parquet").select("item_id").collect()}
    seen, at = set(), min(items)
    while at not in seen:
        seen.add(at)
        at = pairs[at]
    assert seen == items == set(pairs)


def test_whole_texts_reach_the_counter_and_the_extractors(spark):
    same(spark, "src06_lazy_stream", whole("src06_lazy_stream", ("substr(text, 1, 200)", "text")), "sf0.001")
    same(spark, "str05_code_block", whole("str05_code_block", ("substr(text, 1, 30)", "text")), "sf0.001")
    same(spark, "cht05_parse_response", whole("cht05_parse_response", ("substr(text, 10, 50)", "substr(text, 10)")), "sf0.001")


def test_byte_pairs_encode_every_word(spark):
    """Against the public library with the same vocabulary, its own splitting switched off; and ranks that a later merge goes under."""
    tokenizers = pytest.importorskip("tokenizers")
    path = "/root/testdata/sf0.001"
    tool = tokenizers.Tokenizer.from_file(series.VOCABULARY)
    tool.pre_tokenizer = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    tool.normalizer = None
    rows = spark.read.parquet(f"{path}/benchmark.parquet").select("item_id", "text").collect()
    want = sorted((r.item_id, w, " ".join(tool.encode(w, add_special_tokens=False).tokens)) for r in rows for w in r.text.lower().split())
    assert sorted(map(tuple, QUERIES["tok03_byte_pair_encode"](spark, path).collect())) == want
    df = spark.createDataFrame([("théâtre",), ("",), (None,), ("日本",), ("a" * 3000,), ("abab",), ("abab",)], "text string")
    merges = series.merges_of_file(series.VOCABULARY)
    got = {r.text: r.p for r in df.select("text", series.encode_byte_pairs(F.col("text"), merges, "</w>", True).alias("p")).collect()}
    assert got.pop(None) is None and got.pop("") == []
    assert got == {w: tool.encode(w, add_special_tokens=False).tokens for w in got}
    ill = [("ab", "c"), ("b", "c"), ("a", "b")]
    assert [r[0] for r in spark.createDataFrame([("abc",), ("abab",)], "w string").select(series.encode_byte_pairs(F.col("w"), ill)).collect()] == [["a", "bc"], ["ab", "ab"]]


def test_byte_pairs_of_a_short_list(spark):
    path, merges = "/root/testdata/sf0.001", [("t", "h"), ("th", "e"), ("i", "n")]

    def encoded(word):
        symbols = list(word)
        for a, b in merges:
            out = []
            for x in symbols:
                if out and out[-1] == a and x == b:
                    out[-1] = a + b
                else:
                    out.append(x)
            symbols = out
        return " ".join(symbols)

    texts = spark.read.parquet(f"{path}/benchmark.parquet").select("item_id", "text")
    want = sorted((r.item_id, w, encoded(w)) for r in texts.collect() for w in r.text.lower().split())
    words = texts.select("item_id", F.explode(T.plain_tokens(F.col("text"))).alias("w"))
    got = words.select("item_id", "w", F.array_join(series.encode_byte_pairs(F.col("w"), merges), " ").alias("pieces"))
    assert sorted(map(tuple, got.collect())) == want


def test_archive_samples_come_with_all_their_members(spark):
    path = "/root/testdata/sf0.001"
    texts = sorted((r.item_id, r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").select("item_id", "text").collect())
    samples = QUERIES["src20_tar_samples"](spark, path).select("item_id", "text", "meta", "image").collect()
    assert sorted(map(tuple, samples)) == [(i, t, None, "00000000") for i, t in texts]
    pairs = QUERIES["src34_edit_pairs"](spark, path).select("item_id", "text", "source", "target").collect()
    assert sorted(map(tuple, pairs)) == [(i, t, "73", "74") for i, t in texts]
