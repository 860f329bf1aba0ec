import pytest
from pyspark.sql import functions as F

from granary.functions import plugins
from granary.plans import configs
from granary.records import Records, with_retry


def test_records(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text("".join(f'{{"text": "t{i}", "id": {i}}}\n' for i in range(40)))
    r = Records.load(spark, str(tmp_path / "in.jsonl"), "text string, id long")
    assert r.filter("id < 10").df.count() == r.filter(lambda x: x["id"] < 10).df.count() == 10
    assert r.map(lambda x: {"text": x["text"].upper(), "id": x["id"]}).filter(F.col("text").startswith("T3")).df.count() == 11
    train, held = r.split(0.25, 3, "id")
    assert (train.df.count(), held.df.count()) == (30, 10)
    assert {x.id for x in held.df.collect()} == {x.id for x in Records(r.df.repartition(7)).split(0.25, 3, "id")[1].df.collect()}
    order = [x.id for x in r.shuffle(0, "id").df.collect()]
    assert sorted(order) == list(range(40)) and order != sorted(order) and order == [x.id for x in r.shuffle(0, "id").df.collect()]
    blocks = [x.id // 8 for x in r.buffered_shuffle(1, "id", 8).df.collect()]
    assert blocks == sorted(blocks)
    assert r.repeat(3).df.count() == 120 and r.worker(F.col("id"), 1, 4).df.count() == 10 and r.union(r).df.count() == 80
    r.save(str(tmp_path / "out"))
    assert Records.load(spark, str(tmp_path / "out"), "text string, id long").df.count() in (0, 40)
    r.save(str(tmp_path / "out.parquet"), "parquet")
    assert Records.mapped(spark, str(tmp_path / "out.parquet"), {"prompt": "text"}).df.columns == ["prompt"]
    with pytest.raises(ValueError):
        r.save(str(tmp_path / "x"), "csv")


def test_retry():
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "done"

    assert with_retry(flaky, wait=waits.append) == "done" and waits == [1, 2]
    with pytest.raises(OSError):
        with_retry(lambda: (_ for _ in ()).throw(OSError()), 2, waits.append)


class Letters:
    def encode(self, text):
        return [ord(c) for c in text]

    def decode(self, ids):
        return "".join(map(chr, ids))


def test_plugins(spark):
    df = spark.createDataFrame([("ab",), (None,), ("c",)], "text string")
    ids = df.select(plugins.encode_column(Letters(), F.col("text"), eos=0).alias("ids"))
    assert [r.ids for r in ids.collect()] == [[97, 98, 0], None, [99, 0]]
    assert [r[0] for r in ids.select(plugins.decode_column(Letters(), F.col("ids"))).collect()] == ["ab\0", None, "c\0"]
    scored = spark.createDataFrame([("a",), ("bb",)], "c string").select(plugins.reward_column(lambda c: [len(x) / 2 for x in c], F.col("c")))
    assert [r[0] for r in scored.collect()] == [0.5, 1.0]
    registry = plugins.Registry()
    registry.register("x")(1)
    assert registry.get("x") == 1 and registry.names() == ["x"]
    for wrong in (lambda: registry.get("y"), lambda: registry.register("x")(2)):
        with pytest.raises(KeyError):
            wrong()
    rows = plugins.LmWindows(F.array(*map(F.lit, range(8))), F.lit(3)).collect()
    assert [(r.window, r.input_ids, r.labels) for r in rows] == [(0, [0, 1, 2], [1, 2, 3]), (1, [3, 4, 5], [4, 5, 6])]


def test_accumulator_is_independent_of_partitions(spark):
    df = spark.createDataFrame([("k" + str(i % 3), float(i)) for i in range(50)], "k string, v double")
    run = lambda d: sorted(map(tuple, plugins.accumulate(d, ["k"], lambda p: {"n": len(p), "s": float(p["v"].sum())}, lambda a, b: {"n": a["n"] + b["n"], "s": a["s"] + b["s"]}, "k string, n long, s double").collect()))
    assert run(df.repartition(1)) == run(df.repartition(6)) and run(df)[0][1] == 17


def test_configs(spark):
    with pytest.raises(ValueError, match="unknown"):
        configs.strict(configs.Stage, {"name": "a", "max_examples": 3, "colour": 1})
    with pytest.raises(ValueError):
        configs.shares({"a": 0.5, "b": 0.4})
    plan = configs.RunPlan(1000, 10_000, 128, data=4, micro=2)
    assert (plan.tokens_per_step, plan.steps, plan.overshoot, plan.devices, plan.optimal_tokens) == (1024, 10, 240, 4, 20_000)
    assert configs.epoch_steps(101, 4, 8, 3) == 12 and configs.prefix_boundaries(10, 4) == [3, 5, 8, 10]
    rows = spark.createDataFrame([("qa", "m", 50, 10, "Fine"), ("qa", "m", 900, 10, "x"), ("w", "m", 50, 10, "As An AI")], "task string, mode string, num_tokens long, supervised_tokens long, response string")
    assert rows.where(configs.Filters(max_tokens=100, banned=("as an ai",)).condition()).count() == 1
    audit = {r.group: (r.exposures, r.within) for r in configs.audit_exposures(rows, 2, {"g": ("qa",)}, {"g": 0.66, "unassigned": 0.33}, 0.01).collect()}
    assert audit == {"g": (4, True), "unassigned": (2, True)}
