"""Registered queries of shards, manifests, releases and plans: each writes what it is about to the shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import twin as D
from ..dual import Book
from ..functions import text as T
from ..operators import corpus, series
from ..operators.ordering import numbered, zipped
from ..plans import configs
from ..records import Records
from ..session import materialised, scratch
from . import readers

BOOK = Book()
add = BOOK.add
read = lambda spark, sf_dir, name: spark.read.parquet(f"{sf_dir}/{name}.parquet")

#: Tokens of a row, and of a shard beside the one that it shares with the next.
ROW, SHARD = 128, 1024


# ---- token shards --------------------------------------------------------------------------------------------------


def token_shards(spark: SparkSession, docs: DataFrame, shard: int = SHARD, key: str = "doc_id") -> str:
    """The path of docs(key, source, text) as rolling shards (source, shard) of token ids, 0 after each document."""
    vocab = corpus.vocabulary(corpus.frequencies(docs), 1)
    ids = corpus.encode(docs, vocab, key=key, keep=("source",)).select("source", key, F.concat("ids", F.array(F.lit(0).cast("bigint"))).alias("tokens"))
    stream = corpus.placed(ids.withColumn("n", F.size("tokens").cast("long")), key)
    parts = corpus.pieces(stream, shard, 1)
    rows = parts.groupBy("source", F.col("window").alias("shard")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda p: p["part"])).alias("ids"))
    path = scratch(spark, "shards")
    readers.write_token_shards(rows, path, vocab.count() + 1)
    return path


def _shards(s: SparkSession, d: str) -> str:
    return token_shards(s, read(s, d, "documents").select("doc_id", "source", "text"))


def _back(s: SparkSession, d: str) -> DataFrame:
    ids = readers.read_token_shards(s, _shards(s, d))
    return ids.select("source", "shard", F.size("ids").cast("long").alias("n"), F.array_max("ids").alias("top"), F.sha2(F.array_join("ids", " "), 256).alias("digest"))


_IDS = f"""WITH w AS (SELECT source, doc_id, {D.plain_tokens('text')} AS t FROM documents),
    vocab AS MATERIALIZED (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) AS id FROM (SELECT unnest(t) AS token FROM w) GROUP BY token),
    size AS (SELECT CASE WHEN count(*) + 1 <= 65535 THEN 2 ELSE 4 END AS width FROM vocab),
    laid AS (SELECT source, list_append(t, '') AS t, coalesce(sum(len(t) + 1) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w WHERE len(t) > 0),
    stream AS (SELECT source, CAST(before + generate_subscripts(t, 1) - 1 AS BIGINT) AS position, unnest(t) AS token FROM laid),
    ids AS (SELECT source, position, coalesce(id, 0) AS id FROM stream LEFT JOIN vocab USING (token)),
    spread AS (SELECT source, position // {SHARD} AS shard, position, id FROM ids UNION ALL SELECT source, position // {SHARD} - 1, position, id FROM ids WHERE position % {SHARD} = 0 AND position > 0),
    shards AS MATERIALIZED (SELECT source, CAST(shard AS BIGINT) AS shard, count(*) AS n, CAST(max(id) AS BIGINT) AS top, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY position) AS line,
        string_agg(left(printf('%02x%02x%02x%02x', id & 255, (id >> 8) & 255, (id >> 16) & 255, (id >> 24) & 255), 2 * width), '' ORDER BY position) AS hexed, any_value(width) AS width FROM spread, size GROUP BY source, shard),
    listed AS (SELECT source, shard, n, top, CASE width WHEN 2 THEN '<u2' ELSE '<u4' END AS dtype, n * width AS bytes, sha256(unhex(hexed)) AS sha256, line FROM shards)"""
_READ = f"{_IDS} SELECT source, shard, n, top, sha256(line) AS digest FROM listed"
add("src10_token_shards", _back, _READ)
add("snk03_build_shards", lambda s, d: readers.shard_index(s, _shards(s, d), "source").select("source", "shard", "n", "top"), f"{_IDS} SELECT source, shard, n, top FROM listed")
add("snk02_shard_index", lambda s, d: readers.shard_index(s, _shards(s, d), "source"), f"{_IDS} SELECT source, shard, n, top, dtype, CAST(bytes AS BIGINT) AS bytes, sha256 FROM listed")
_MANIFEST = f"SELECT source, count(*) AS shards, CAST(sum((n - 1) // {ROW}) AS BIGINT) AS rows, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(bytes) AS BIGINT) AS bytes FROM listed GROUP BY source"


def _manifest(s: SparkSession, d: str) -> DataFrame:
    """The manifest, written as JSON lines and read again."""
    made = readers.source_manifest(readers.shard_index(s, _shards(s, d), "source"), ROW)
    path = scratch(s, "manifest") + ".jsonl"
    readers.write_json_lines(made, path)
    return readers.json_lines(s, path, made.schema)


add("snk06_source_manifest", _manifest, f"{_IDS} {_MANIFEST}")
add("snk11_fingerprint", lambda s, d: readers.fingerprint(readers.shard_index(s, _shards(s, d), "source"), "source"), f"{_IDS} SELECT source, count(*) AS shards, sha256(string_agg(shard || ':' || dtype || ':' || n || ':' || top || ':' || sha256, chr(10) ORDER BY shard)) AS fingerprint FROM listed GROUP BY source")


def _damaged(s: SparkSession, d: str) -> tuple[DataFrame, str]:
    """The index of the shards, and a copy of them where src1 has a byte flipped, src2 is cut short and src3 lacks a shard."""
    path = _shards(s, d)
    first, data = F.col("shard") == 0, F.col("data")
    n = F.length(data)
    flipped = F.concat(F.substring(data, F.lit(1), n - 1), F.when(F.substring(data, n, F.lit(1)) == F.unhex(F.lit("00")), F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00"))))
    changed = F.when(first & (F.col("source") == "src1"), flipped).when(first & (F.col("source") == "src2"), F.substring(data, F.lit(1), n - 2)).otherwise(data)
    s.read.parquet(path).where(~(first & (F.col("source") == "src3"))).withColumn("data", changed).write.parquet(path + "-copy")
    return readers.shard_index(s, path, "source"), path + "-copy"


def _verified(s: SparkSession, d: str) -> DataFrame:
    index, path = _damaged(s, d)
    return readers.verify_shards(s, path, index, "source")


add("snk07_verify_sizes", _verified, f"{_IDS} SELECT source, shard, CASE WHEN shard > 0 THEN 'ok' WHEN source = 'src1' THEN 'digest' WHEN source = 'src2' THEN 'size' WHEN source = 'src3' THEN 'missing' ELSE 'ok' END AS status FROM listed")


def _faults(s: SparkSession, d: str) -> DataFrame:
    """The faults of an index where src1 has no shards, src2 one twice, and src3 wrong sizes, under the manifest of the right one."""
    index = readers.shard_index(s, _shards(s, d), "source")
    manifest = readers.source_manifest(index, ROW)
    wrong = index.where("source <> 'src1'").withColumn("bytes", F.when(F.col("source") == "src3", F.col("bytes") + 1).otherwise(F.col("bytes")))
    return readers.manifest_faults(wrong.unionByName(index.where("source = 'src2' and shard = 0")), manifest, ROW)


add("snk05_manifest_invariants", _faults, "SELECT * FROM (VALUES ('src1', 'no shards'), ('src2', 'names repeat'), ('src2', 'listing incomplete'), ('src2', 'rows differ'), ('src3', 'bytes differ')) t(source, fault)")


def _mixture(s: SparkSession, d: str) -> DataFrame:
    path = _shards(s, d)
    shards = readers.validated_mixture(s, path, readers.source_manifest(readers.shard_index(s, path, "source"), ROW), ROW)
    return shards.groupBy("source").agg(F.count("*").alias("shards"), F.sum(F.size("ids")).alias("tokens"), F.sum(F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("total"))


add("src12_validated_mixture", _mixture, f"{_IDS} SELECT source, count(DISTINCT shard) AS shards, count(*) AS tokens, CAST(sum(id) AS BIGINT) AS total FROM spread GROUP BY source")


def _examples(s: SparkSession, d: str) -> DataFrame:
    """Benchmark items as examples of four shards of token lengths, read through their index."""
    items = read(s, d, "benchmark").select("item_id", F.pmod("item_id", F.lit(4)).alias("source"), F.transform(T.plain_tokens(F.col("text")), lambda t: F.length(t).cast("bigint")).alias("tokens")).where(F.size("tokens") > 0)
    laid = corpus.running_total(items.withColumn("n", F.size("tokens").cast("long")), ["source"], "item_id", "n")
    path = scratch(s, "examples")
    readers.write_token_shards(laid.groupBy(F.col("source").alias("shard")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("before", "tokens"))), lambda p: p["tokens"])).alias("ids")), path, 1000)
    index = laid.select(F.col("item_id").alias("example_id"), F.col("source").alias("shard"), F.col("before").alias("offset"), "n", F.lit("plain-v1").alias("template_id"))
    return readers.indexed_examples(index, readers.read_token_shards(s, path), "plain-v1").select("example_id", F.array_join("ids", " ").alias("ids"))


add("src16_indexed_shards", _examples, f"SELECT item_id AS example_id, array_to_string([length(x) FOR x IN {D.plain_tokens('text')}], ' ') AS ids FROM benchmark")


# ---- files, listings, releases -------------------------------------------------------------------------------------


def _renamed(s: SparkSession, folder: str, suffix: str) -> None:
    """Give the files of a folder another suffix; names alone are touched."""
    jvm = s._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(s._jsc.hadoopConfiguration())
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("part-"):
            fs.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(path, name.rsplit(".", 1)[0] + suffix))


def _directory(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "dir")
    df = read(s, d, "benchmark")
    df.where("item_id % 2 = 0").select(F.to_json(F.struct("text")).alias("value")).write.text(f"{path}/a")
    _renamed(s, f"{path}/a", ".jsonl")
    df.where("item_id % 2 = 1").select("text").write.text(f"{path}/b")
    return readers.directory(s, path)


add("src05_directory", _directory, "SELECT text FROM benchmark WHERE item_id % 2 = 0 UNION ALL " + f"SELECT {D.strip('x')} FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM benchmark WHERE item_id % 2 = 1) WHERE {D.strip('x')} <> ''")


def _folders(s: SparkSession, d: str) -> str:
    """A folder region=<key> for each region, a file of its nations' names in each."""
    path = scratch(s, "folders")
    rows = read(s, d, "nation").select(F.col("n_regionkey").alias("region"), "n_nationkey", F.col("n_name").alias("value"))
    rows.repartition("region").sortWithinPartitions("region", "n_nationkey").select("region", "value").write.partitionBy("region").text(path)
    return path


_FOLDER = "element_at(split(path, '/'), -2)"
_LINES = "string_agg(n_name || chr(10), '' ORDER BY n_nationkey)"
add("src14_listing", lambda s, d: readers.listing(s, _folders(s, d)).groupBy(F.expr(_FOLDER).alias("folder")).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes")), f"SELECT 'region=' || n_regionkey AS folder, 1::BIGINT AS files, CAST(strlen({_LINES}) AS BIGINT) AS bytes FROM nation GROUP BY n_regionkey")
add("snk13_release_manifest", lambda s, d: readers.release_manifest(s, _folders(s, d), read(s, d, "region").select(F.concat(F.lit("region="), "r_regionkey").alias("name")), "*.txt"), f"SELECT 'region=' || n_regionkey AS name, 1::BIGINT AS files, CAST(strlen({_LINES}) AS BIGINT) AS bytes, sha256({_LINES}) AS sha256 FROM nation GROUP BY n_regionkey")


def _mapped(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "mapped") + ".jsonl"
    readers.write_json_lines(read(s, d, "benchmark").withColumn("extra", F.lit("x")), path)
    return Records.mapped(s, path, {"prompt": "text", "example_id": "item_id"}, "item_id long, text string").df


add("src18_mapped_fields", _mapped, "SELECT text AS prompt, item_id AS example_id FROM benchmark")


def _coco(s: SparkSession, d: str) -> DataFrame:
    """Suppliers as boxes on images of their nations, with the regions' keys, spread out, as categories."""
    category = (F.col("n_regionkey") * 3 + 7).cast("long")
    nations = read(s, d, "nation")
    images = nations.agg(F.collect_list(F.struct(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("file_name"))).alias("images"))
    boxes = read(s, d, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    boxes = boxes.agg(F.collect_list(F.struct(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("image_id"), category.alias("category_id"), F.array(F.col("s_suppkey").cast("double"), F.lit(2.0), F.lit(3.0), F.lit(4.0)).alias("bbox"))).alias("annotations"))
    kinds = nations.select(category.alias("id")).distinct().agg(F.collect_list(F.struct("id")).alias("categories"))
    path = scratch(s, "coco")
    images.crossJoin(boxes).crossJoin(kinds).select(F.to_json(F.struct("images", "annotations", "categories")).alias("value")).coalesce(1).write.text(path)
    return readers.coco_boxes(s, path)


add("src21_category_remap", _coco, "SELECT CAST(s_nationkey AS BIGINT) AS image_id, n_name AS file_name, CAST(dense_rank() OVER (ORDER BY n_regionkey) - 1 AS INTEGER) AS class, CAST(s_suppkey AS DOUBLE) AS x, 2.0::DOUBLE AS y, 3.0::DOUBLE AS w, 4.0::DOUBLE AS h FROM supplier JOIN nation ON s_nationkey = n_nationkey")
add("src29_line_zip", lambda s, d: zipped(read(s, d, "embeddings").select("vec_id"), "vec_id", read(s, d, "embeddings").select((-F.col("vec_id")).alias("o"), F.col("label").alias("answer")), "o").select("line", "vec_id", "answer"), "WITH a AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS line FROM embeddings), b AS (SELECT label AS answer, row_number() OVER (ORDER BY vec_id DESC) - 1 AS line FROM embeddings) SELECT line, vec_id, answer FROM a JOIN b USING (line)")


def _submission(s: SparkSession, d: str) -> DataFrame:
    """Pages may share an url, so a prediction belongs to a place in the list, not to an url."""
    prediction = F.when(F.pmod("page_id", F.lit(50)) == 0, 9).otherwise(F.pmod("page_id", F.lit(7))).cast("int")
    pages = read(s, d, "pages").select("page_id", F.col("url").alias("path"), prediction.alias("prediction"))
    lines = materialised(numbered(pages, "page_id", out="index").select("index", "path", "prediction"), "lines")
    paths, path = lines.select("index", "path"), scratch(s, "submission")
    readers.write_submission(lines.select("index", "prediction"), paths, path)
    got = materialised(readers.read_submission(s, path), "read")
    return got.join(readers.submission_faults(got, paths, 7), "index", "left").select("index", "path", "prediction", "fault")


add("snk09_submission", _submission, "SELECT row_number() OVER (ORDER BY page_id) - 1 AS index, url AS path, CAST(CASE WHEN page_id % 50 = 0 THEN 9 ELSE page_id % 7 END AS INTEGER) AS prediction, CASE WHEN page_id % 50 = 0 THEN 'class' END AS fault FROM pages")


def _cached(s: SparkSession, d: str) -> DataFrame:
    """Counts made, taken from the cache though the table is another one by then, and made again under another identity."""
    path = scratch(s, "cache")
    counted = lambda name, key: lambda: read(s, d, name).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
    steps = []
    for step, (identity, compute) in enumerate([("a", counted("customer", "c_nationkey")), ("a", counted("supplier", "s_nationkey")), ("b", counted("supplier", "s_nationkey"))]):
        got = readers.cached_counts(s, path, {"table": identity}, compute).withColumn("step", F.lit(step))
        kept = scratch(s, "cached")
        got.write.parquet(kept)
        steps.append(s.read.parquet(kept))
    return steps[0].unionByName(steps[1]).unionByName(steps[2])


add("snk12_count_cache", _cached, "SELECT c_nationkey AS key, count(*) AS n, step FROM customer, (VALUES (0), (1)) t(step) GROUP BY c_nationkey, step UNION ALL SELECT s_nationkey, count(*), 2 FROM supplier GROUP BY s_nationkey")
add("snk14_release_gate", lambda s, d: read(s, d, "orders").select("o_orderkey", configs.release_ready(F.struct(F.when(F.col("o_orderstatus") == "F", "passed").when(F.col("o_orderstatus") == "O", "failed").alias("quality_status"), F.struct((F.col("o_totalprice") > 1000).alias("ready")).alias("release_quality"), (F.pmod("o_orderkey", F.lit(2)) == 0).alias("envelope"), (F.pmod("o_orderkey", F.lit(3)) == 0).alias("template_envelope"))).alias("ready")), "SELECT o_orderkey, o_orderstatus = 'F' AND o_totalprice > 1000 AND o_orderkey % 6 <> 0 AS ready FROM orders")
add("snk17_pending_uploads", lambda s, d: readers.pending(read(s, d, "customer").select(F.when(F.pmod("c_custkey", F.lit(100)) == 0, F.concat("c_custkey", F.lit("-final"))).otherwise(F.concat(F.lit("step-"), "c_custkey")).alias("name"), (F.col("c_acctbal") > 0).alias("complete")), read(s, d, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("step-"), "o_custkey").alias("name"))), "SELECT name, step, row_number() OVER (ORDER BY step, name) - 1 AS place FROM (SELECT CASE WHEN c_custkey % 100 = 0 THEN c_custkey || '-final' ELSE 'step-' || c_custkey END AS name, CASE WHEN c_custkey % 100 = 0 THEN -1 ELSE c_custkey END AS step FROM customer WHERE c_acctbal > 0 AND (c_custkey % 100 = 0 OR c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')))")


# ---- plans ---------------------------------------------------------------------------------------------------------


def _eligible(s: SparkSession, d: str) -> DataFrame:
    rule = configs.Filters(include_tasks=("src1", "src2", "src3"), modes=("en", "fr", "es"), max_tokens=4000, banned=("@",))
    return read(s, d, "documents").where(rule.condition("source", "lang", "n_chars", "n_chars", "text")).select("doc_id")


add("flt07_eligibility", _eligible, "SELECT doc_id FROM documents WHERE source IN ('src1', 'src2', 'src3') AND lang <> 'de' AND n_chars <= 4000 AND NOT contains(text, '@')")
add("flt17_safe_path", lambda s, d: read(s, d, "pages").select("page_id", readers.safe_path(F.regexp_replace("url", "^https?://", "")).alias("safe")), "SELECT page_id, NOT regexp_matches('/' || regexp_replace(url, '^https?://', '') || '/', '/\\.{0,2}/') AS safe FROM pages")
_GROUPS = {"a": tuple(f"src{i}" for i in range(5)), "b": tuple(f"src{i}" for i in range(5, 12))}
add("agg04_exposures", lambda s, d: configs.audit_exposures(read(s, d, "documents").select(F.col("source").alias("task")), 3, _GROUPS, {"a": 0.25, "b": 0.5}, 0.1).select("group", "exposures", F.round("share", 9).alias("share"), "target", "within"), "WITH n AS (SELECT CASE WHEN CAST(source[4:] AS INTEGER) < 5 THEN 'a' WHEN CAST(source[4:] AS INTEGER) < 12 THEN 'b' ELSE 'unassigned' END AS \"group\", count(*) * 3 AS exposures FROM documents GROUP BY 1), x AS (SELECT *, exposures / sum(exposures) OVER () AS share, CASE \"group\" WHEN 'a' THEN 0.25::DOUBLE WHEN 'b' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS target FROM n) SELECT \"group\", exposures, round(share, 9) AS share, target, abs(share - target) <= 0.1 AS within FROM x")


def _plans(s: SparkSession, d: str) -> DataFrame:
    regions = [r.r_regionkey for r in read(s, d, "region").select("r_regionkey").collect()]  # a plan for each region
    plans = [(k, configs.RunPlan(parameters=100 + k, target_tokens=1_000_000_000, length=2048, data=1 + k, micro=8)) for k in regions]
    return s.createDataFrame([(k, p.tokens_per_step, p.steps, p.overshoot, p.optimal_tokens, p.devices) for k, p in plans], "r_regionkey int, tokens_per_step long, steps long, overshoot long, optimal long, devices int")


add("agg37_cluster_plan", _plans, "SELECT r_regionkey, CAST(t AS BIGINT) AS tokens_per_step, CAST(ceil(1e9 / t) AS BIGINT) AS steps, CAST(ceil(1e9 / t) * t - 1e9 AS BIGINT) AS overshoot, CAST(20 * (100 + r_regionkey) AS BIGINT) AS optimal, 1 + r_regionkey AS devices FROM (SELECT r_regionkey, 16384 * (1 + r_regionkey) AS t FROM region)")
add("pck13_epoch_schedule", lambda s, d: (lambda n: s.createDataFrame([(w, b, configs.epoch_steps(n, w, b, 3)) for w in (1, 2, 7) for b in (1, 8, 64)], "world int, batch int, steps long"))(read(s, d, "documents").count()), "SELECT world, batch, CAST(ceil(ceil(n / world) / batch) * 3 AS BIGINT) AS steps FROM (SELECT count(*) AS n FROM documents), (VALUES (1), (2), (7)) w(world), (VALUES (1), (8), (64)) b(batch)")
add("pck15_pack_boundaries", lambda s, d: (lambda n: s.createDataFrame(list(enumerate(configs.prefix_boundaries(n, 10), 1)), "p int, boundary long"))(read(s, d, "documents").agg(F.sum("n_chars")).first()[0]), "SELECT CAST(p AS INTEGER) AS p, CAST((p * n + 9) // 10 AS BIGINT) AS boundary FROM (SELECT sum(n_chars) AS n FROM documents), range(1, 11) r(p)")
add("pck16_contracts", lambda s, d: s.createDataFrame([(k, v["overlap"], v["tail"], v["eos"]) for k, v in configs.CONTRACTS.items()], "contract string, overlap int, tail string, eos string"), "SELECT * FROM (VALUES ('token_stream', 1, 'dropped', 'after each document'), ('batch', 0, 'padded', 'after each document'), ('offline', 0, 'short', 'none'), ('examples', 0, 'padded', 'separator between examples')) t(contract, overlap, tail, eos)")
add("stm07_epochs", lambda s, d: Records(read(s, d, "benchmark").select("item_id")).repeat(3).df, "SELECT item_id, CAST(e AS INTEGER) AS epoch FROM benchmark, range(3) r(e)")
add("mix13_ratio_quotas", lambda s, d: series.ratio_quotas(corpus._weights(s, d).select("source", "weight"), 1001, ("src1", "src2")).select("source", "quota"), "WITH w AS (SELECT source, 1e0 / row_number() OVER (ORDER BY source) AS w FROM (SELECT DISTINCT source FROM documents)), q AS (SELECT source, CAST(floor(w / sum(w) OVER () * 1001 + 1e-9) AS BIGINT) AS q FROM w) SELECT source, CASE WHEN source IN ('src1', 'src2') THEN q + q % 2 ELSE q END AS quota FROM q")
add("mix12_hard_negatives", lambda s, d: series.bounded_negatives(read(s, d, "embeddings").select("label", "vec_id"), "label", "vec_id", 3))

# ---- supervision ---------------------------------------------------------------------------------------------------

_FIVE = [5, 9, 1, 2, 0], [9, 1, 4, 0, 9, 1, 8]


def _relabelled(s: SparkSession, d: str) -> DataFrame:
    ids = F.array(*[F.lit(x) for x in _FIVE[0]], F.col("p_size"), *[F.lit(x) for x in _FIVE[1]])
    examples = read(s, d, "part").select(F.col("p_partkey").alias("example_id"), "p_size", ids.alias("ids")).withColumn("labels", F.transform("ids", lambda x, i: F.when(i == 3, x).otherwise(F.lit(-100))))
    out = series.relabelled(examples, [9, 1], 0).join(examples.select("example_id", "p_size"), "example_id")
    return out.groupBy("p_size", "digest").agg(F.count("*").alias("examples"), F.sum("was").alias("was"), F.sum("supervised").alias("supervised"))


add("pck12_relabel_counts", _relabelled, "SELECT p_size, sha256('5 9 1 2 0 ' || p_size || ' 9 1 4 0 9 1 8|-100 -100 -100 2 0 -100 -100 -100 4 0 -100 -100 -100') AS digest, count(*) AS examples, CAST(count(*) AS BIGINT) AS was, CAST(4 * count(*) AS BIGINT) AS supervised FROM part GROUP BY p_size")


def _enveloped(s: SparkSession, d: str) -> DataFrame:
    """Items as lengths of their tokens; of every ten places those from the fourth on are supervised, each naming the next token."""
    ids = F.transform(T.plain_tokens(F.col("text")), lambda t: F.length(t).cast("bigint"))
    rows = read(s, d, "benchmark").select("item_id", ids.alias("ids")).where(F.size("ids") > 5)
    labels = F.transform("ids", lambda x, i: F.when(i % 10 >= 3, F.coalesce(F.get("ids", i + 1), F.lit(0).cast("bigint"))).otherwise(F.lit(-100).cast("bigint")))
    rows = rows.withColumn("labels", labels)
    return rows.select("item_id", series.reasoning_envelope(F.col("ids"), F.col("labels"), [901, 902], [903], 0, 24).alias("e")).select("item_id", F.array_join("e.ids", " ").alias("ids"), F.array_join("e.labels", " ").alias("labels"))


add("pck10_envelope", _enveloped, f"""WITH t AS (SELECT item_id, [CAST(length(x) AS BIGINT) FOR x IN {D.plain_tokens('text')}] AS x FROM benchmark),
    p AS (SELECT item_id, x, len(x) AS n, CASE WHEN (len(x) - 1) % 10 >= 3 THEN len(x) - (len(x) - 1) % 10 + 3 ELSE len(x) - (len(x) - 1) % 10 - 7 END AS start FROM t WHERE len(x) > 5),
    a AS (SELECT item_id, x[1:start] AS prompt, [v FOR v IN x[start + 1:least(start + 7, n)] IF v <> 0] AS answer FROM p),
    c AS (SELECT item_id, prompt, list_concat([901, 902]::BIGINT[], answer[1:20], [903, 0]::BIGINT[]) AS c FROM a),
    k AS (SELECT item_id, c, prompt[greatest(1, len(prompt) - greatest(1, 25 - len(c)) + 1):] AS prompt FROM c),
    f AS (SELECT item_id, len(prompt) AS m, list_concat(prompt, c) AS f FROM k)
    SELECT item_id, array_to_string(list_concat(f[1:len(f) - 1], [0 FOR i IN range(25 - len(f))]), ' ') AS ids, array_to_string(list_concat([-100 FOR i IN range(m - 1)], f[m + 1:], [-100 FOR i IN range(25 - len(f))]), ' ') AS labels FROM f""")

QUERIES, ORACLES = BOOK.queries, BOOK.oracles
