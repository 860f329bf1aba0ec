"""Operators against small hand-made cases and plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import chat, corpus, detection, relational, routing, series
from granary.streaming import monitor


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_cleaner_and_choices(spark):
    assert one(spark, T.clean(F.col("x")), x="<p>See https://a.b/c and  a@b.org NOW</p> please") == "see and now please"
    assert one(spark, T.clean(F.col("x"), min_length=50), x="short") is None
    for text, want in {"The answer is b.": "B", r"\boxed{C}": "C", "x\nD) yes": "D", "so **a**!": "A", "A or B": "A", "it is A or B": "B", "none": None}.items():
        assert one(spark, T.choice_answer(F.col("x")), x=text) == want, text


@pytest.mark.parametrize("seed", range(5))
def test_next_fit_is_the_plain_loop(spark, seed):
    rng = random.Random(seed)
    lengths = [rng.randrange(1, 60) for _ in range(200)]
    packs, pack, used = [], -1, 0
    for n in lengths:
        if pack >= 0 and used + 1 + n <= 64:
            used += 1 + n
        else:
            pack, used = pack + 1, n
        packs.append(pack)
    df = spark.createDataFrame([("g", i, n) for i, n in enumerate(lengths)], "g string, o long, n long").repartition(5)
    got = [r.pack for r in sorted(corpus.next_fit(df, "g", "o", "n", 64).collect(), key=lambda r: r.o)]
    assert got == packs


def test_fair_queue_is_the_plain_queue(spark):
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    counts, order = dict.fromkeys(weights, 0), []
    for _ in range(60):
        s = min(weights, key=lambda s: (counts[s] / weights[s], s))
        order.append((s, counts[s]))
        counts[s] += 1
    rows = spark.createDataFrame([(s, i) for s in weights for i in range(100)], "source string, i long")
    sources = spark.createDataFrame([(s, w, i) for i, (s, w) in enumerate(weights.items())], "source string, weight double, position int")
    got = [(r.source, r.i) for r in corpus.fair_queue(rows, sources, "i").orderBy("key", "position").limit(60).collect()]
    assert got == order


def test_layout_of_a_large_budget():
    weights = {"a": 0.45, "b": 0.30, "c": 0.10, "d": 0.05, "e": 0.05, "f": 0.05}
    rows, tokens, split = corpus.layout(200_000_000_000, 1024, 512, weights)
    assert (rows, tokens, sum(split.values())) == (195_312_640, 200_000_143_360, rows)


def test_running_total_over_blocks(spark):
    data = [("k", i, (i * 7) % 5) for i in range(1000)] + [("l", i, 1) for i in range(10)]
    got = {(r.k, r.o): r.before for r in corpus.running_total(spark.createDataFrame(data, "k string, o long, n long").repartition(7), ["k"], "o", "n", 64).collect()}
    total = 0
    for k, o, n in data[:1000]:
        assert got[k, o] == total
        total += n


def test_running_total_keeps_rows_without_a_key(spark):
    rows = [(None if i % 3 else "a", i * 1000, i % 5) for i in range(40)]
    got = {r.o: r.before for r in corpus.running_total(spark.createDataFrame(rows, "k string, o long, n long"), ["k"], "o", "n").collect()}
    assert got == {o: sum(n for key, p, n in rows if key == k and p < o) for k, o, _ in rows}


def test_mixture_faults(spark):
    make = lambda *rows: spark.createDataFrame(rows, "name string, weight double, dataset_id string, data_files string")
    assert corpus.mixture_faults(make(("a", 0.5, "x", None), ("b", 0.5, None, "y"))).count() == 0
    found = {r.fault for r in corpus.mixture_faults(make(("a", 0.5, "x", None), ("a", 0.4, None, None))).collect()}
    assert found == {"duplicate names", "weights do not sum to 1", "needs exactly one of dataset and files"}


def test_vocabulary_round_trip(spark):
    docs = spark.createDataFrame([(1, "b a b"), (2, "c b a")], "doc_id long, text string")
    vocab = corpus.vocabulary(corpus.frequencies(docs))
    assert {r.token: r.token_id for r in vocab.collect()} == {"b": 0, "a": 1, "c": 2}
    assert {r.doc_id: r.text for r in corpus.decode(corpus.encode(docs, vocab), vocab).collect()} == {1: "b a b", 2: "c b a"}


def test_quotas_follow_the_weights():
    assert relational.deficit_quotas({"a": 200, "b": 200, "c": 200}, {"a": 0.7, "b": 0.2, "c": 0.1}, 100) == {"a": 70, "b": 20, "c": 10}
    assert relational.deficit_quotas({"a": 5, "b": 200}, {"a": 0.9, "b": 0.1}, 50) == {"a": 5, "b": 45}


def test_stages_grow(spark):
    rows = spark.createDataFrame([(i, "qwp"[i % 3]) for i in range(120)], "id long, task string")
    first = relational.curriculum_stage(rows, None, "task", "id", 30)
    second = relational.curriculum_stage(rows, first, "task", "id", 60)
    a, b = {r.id for r in first.collect()}, {r.id for r in second.collect()}
    assert len(a) == 30 and len(b) == 60 and a <= b
    again = relational.curriculum_stage(rows.repartition(9).orderBy(F.desc("id")), None, "task", "id", 30)
    assert {r.id for r in again.collect()} == a


def test_bounded_weights_have_mean_one(spark):
    df = spark.createDataFrame([(1, 0.1), (2, 0.5), (3, 1.0), (4, 30.0)], "id long, weight double")
    got = [r.bounded for r in relational.bounded_mean_one(df, 0.2, 2.0).collect()]
    assert abs(sum(got) / 4 - 1) < 1e-6 and min(got) >= 0.2 and max(got) <= 2.0


def test_mixer_at_its_extremes(spark):
    values = [0, 1, 0xFFFFFFFF, 0x80000000, 0x12345678, 1 << 40]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x long").select(routing.mix32(F.col("x"))).collect()]
    assert got == [routing.mix32_int(v) for v in values]


@pytest.mark.parametrize("strategy", [routing.affine_routes, routing.multi_hash_routes, routing.modulo_routes, routing.balanced_routes])
def test_routes_are_valid(spark, strategy):
    routes = strategy(spark, 256, 8, 2)
    assert routes.count() == 512 and routing.route_faults(routes, 8, 2).count() == 0
    if strategy is routing.balanced_routes:
        assert {r["count"] for r in routes.groupBy("route", "expert").count().collect()} == {32}


def test_templates_and_parser(spark):
    turns = spark.createDataFrame([(1, 0, "system", "S"), (1, 1, "user", "U"), (1, 2, "assistant", "A")], "conv_id long, turn long, role string, text string")
    m = chat.messages(turns)
    assert m.select(chat.llama_template(F.col("messages"))).first()[0] == "<|begin|>[INST]<|system|>\nS\n<|/system|>\n\nU[/INST] A <|end|> "
    assert m.select(chat.native_template(F.col("messages"), False)).first()[0] == "<|begin|>\n<|system|>\nS\n<|/system|>\n<|turn|>\n<|user|>\nU\n<|/user|>\n<|/turn|>\n<|turn|>\n<|assistant|>\nA\n<|/assistant|>\n<|/turn|>\n"
    p = one(spark, chat.parse_response(F.col("x")), x="<|reason|><|step|>a<|/step|>b<|conclude|>c<|/conclude|><|/reason|>text<|/assistant|>")
    assert (p.content, p.reasoning, p.steps, p.conclusion, p.calls) == ("text", "b", ["a"], "c", None)
    with pytest.raises(Exception, match="unsupported role"):
        chat.messages(turns.withColumn("role", F.lit("robot"))).select(chat.sft_prompt(F.col("messages"), "", ("", ""), "", "")).collect()


def test_calculator_and_dates(spark):
    assert [series.calculate(x) for x in ("2+3*4", "7/2", "2**10", "2**11", "1/0", "__import__('os')", "-3%5", "4/2")] == ["14", "3.5", "1024", None, None, None, "2", "2"]
    assert one(spark, series.date_answer(F.col("x")), x="weekday of 2024-02-29?") == "Thursday"
    assert one(spark, series.date_answer(F.col("x")), x="2024-02-28 plus 2 days") == "2024-03-01"
    assert one(spark, series.arithmetic_expression(F.col("x")), x="Combien fait 3 + 4 ?") == "3+4"
    assert one(spark, series.arithmetic_expression(F.col("x")), x="2024-01-01 plus 3") is None


def test_relabel_supervises_every_span(spark):
    ids = [5, 9, 1, 2, 3, 0, 6, 9, 1, 4, 0, 9, 1, 8]
    got = one(spark, series.relabel(F.col("i"), F.transform("i", lambda _: F.lit(-100).cast("long")), [9, 1], 0), i=ids)
    assert got == [-100, -100, -100, 2, 3, 0, -100, -100, -100, 4, 0, -100, -100, -100]


def test_byte_pairs(spark):
    counts = spark.createDataFrame([("low", 5), ("lower", 2), ("newest", 6), ("widest", 3)], "token string, cnt long")
    merges = series.train_byte_pairs(counts, 3)
    assert merges == [("e", "s"), ("es", "t"), ("l", "o")]
    assert one(spark, series.encode_byte_pairs(F.col("w"), merges), w="lowest") == ["lo", "w", "est"]


def test_longest_common_subsequence(spark):
    pairs = spark.createDataFrame([(1, 0, "a b c d", "a x c d y"), (1, 2, "", "a")], "conv_id long, turn long, reference string, candidate string")
    from granary.operators import text

    assert {r.turn: r.lcs for r in text.rouge_l(pairs).collect()} == {0: 3, 2: 0}
    assert pairs.where("turn = 0").select(text.lcs_length(F.split("reference", " "), F.split("candidate", " "))).first()[0] == 3


def boxes(spark, rows):
    rows = [(*r[:3], *map(float, r[3:])) for r in rows]
    return spark.createDataFrame(rows, "image long, label int, box int, x1 double, y1 double, x2 double, y2 double, score double")


def test_detection_scores(spark):
    targets = boxes(spark, [(1, 0, 1, 0.25, 0.25, 0.75, 0.75, 1.0), (2, 1, 1, 0.0, 0.0, 0.1, 0.1, 1.0)])
    perfect = detection.detection_scores(targets, targets).first()
    assert (perfect.ap50, perfect.ap, perfect.f1) == (1.0, 1.0, 1.0)
    loose = boxes(spark, [(1, 0, 1, 0.2, 0.2, 0.8, 0.8, 0.9)])
    got = detection.detection_scores(loose, targets.where("image = 1")).first()
    assert got.ap50 == 1.0 and 0 < got.ap < 1


def test_suppression_keeps_the_best(spark):
    rows = boxes(spark, [(1, 0, 1, 0, 0, 10, 10, 0.5), (1, 0, 2, 1, 1, 10, 10, 0.9), (1, 0, 3, 50, 50, 60, 60, 0.1), (1, 1, 4, 0, 0, 10, 10, 0.2)])
    assert sorted(r.box for r in detection.suppress(rows, 0.5).collect()) == [2, 3, 4]


def test_stream_of_buffers(spark, tmp_path):
    spark.createDataFrame([(i % 2, float(i)) for i in range(20)], "key long, v double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = monitor.bounded_buffer(monitor.read_events(spark, str(tmp_path / "in"), "key long, v double"), "key", "v", 8, 5)
    got = monitor.drain(stream, "buffers", "append", str(tmp_path / "ck")).collect()
    assert sorted((r.key, r.n) for r in got) == [(0, 5), (0, 5), (1, 5), (1, 5)]


def test_positions_without_a_global_window(spark):
    from granary.operators import ordering

    data = [(i * 37 % 500, i) for i in range(500)]
    df = spark.createDataFrame(data, "v long, id long").repartition(7)
    got = {r.id: r.position for r in ordering.numbered(df, "v", "id").collect()}
    assert got == {i: p for p, (_, i) in enumerate(sorted(data))}
    assert ordering.nearest_rank(df, "v", {"a": 0.5, "b": 1.0}, "id").first() == (sorted(v for v, _ in data)[round(499 * 0.5)], 499)
    digest = F.sha2(F.col("id").cast("string"), 256)
    import hashlib

    hashes = sorted(hashlib.sha256(str(i).encode()).hexdigest() for i in range(500))
    assert [ordering.cut_of_hash(df, digest, n) for n in (0, 1, 250, 500)] == ["", hashes[0], hashes[249], hashes[499]]
    other = spark.createDataFrame([(i, chr(97 + i % 26)) for i in range(500)], "n long, c string")
    assert ordering.zipped(df.select("v"), "v", other, "n").where("v <> n").count() == 0
    with pytest.raises(ValueError):
        ordering.zipped(df, "v", other.limit(3), "n")


def test_matching_against_a_plain_loop(spark):
    rng = random.Random(5)
    make = lambda n: [(rng.randrange(12), rng.randrange(2), i, x := rng.uniform(0, 20), y := rng.uniform(0, 20), x + rng.uniform(4, 12), y + rng.uniform(4, 12), round(rng.random(), 2)) for i in range(n)]
    left, right = make(120), make(60)

    def iou(a, b):
        w, h = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
        inter = max(w, 0) * max(h, 0)
        return inter / ((a[5] - a[3]) * (a[6] - a[4]) + (b[5] - b[3]) * (b[6] - b[4]) - inter)

    want = {}
    for limit in detection.THRESHOLDS:
        used = set()
        for p in sorted(left, key=lambda p: (-p[7], p[2])):
            free = [t for t in right if t[:2] == p[:2] and t[2] not in used]
            best = max(free, key=lambda t: (iou(p, t), -t[2]), default=None)
            hit = best is not None and iou(p, best) >= limit
            if hit:
                used.add(best[2])
            want.setdefault(p[2], []).append(hit)
    got = {r.box: r.hits for r in detection.match(boxes(spark, left), boxes(spark, right)).collect()}
    assert got == want
