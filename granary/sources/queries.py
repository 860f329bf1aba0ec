"""Registered queries of readers and writers: tables are written to the shared folder in a format and read back from it."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import twin as D
from ..dual import Book
from ..functions import text as T
from ..operators import corpus, routing
from ..session import scratch
from . import readers

BOOK = Book()
add, both = BOOK.add, BOOK.both
read = lambda spark, sf_dir, name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_json_lines(df: DataFrame, name: str) -> str:
    path = scratch(df.sparkSession, name) + ".jsonl"
    readers.write_json_lines(df, path)
    return path


def _docs(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").select("doc_id", "source", "text")


_DOC = "doc_id long, source string, text string"
_BACK = "SELECT doc_id, source, text FROM documents"
add("src02_json_lines", lambda s, d: readers.json_lines(s, as_json_lines(_docs(s, d), "jsonl"), _DOC), _BACK)
add("src07_skip_bad_lines", lambda s, d: (lambda p: (_docs(s, d).where("doc_id % 50 = 0").select(F.concat(F.lit("{broken "), "doc_id").alias("value")).write.mode("append").text(p), readers.json_lines(s, p, _DOC, "skip"))[1])(as_json_lines(_docs(s, d), "bad")), _BACK)
add("src17_strict_json_lines", lambda s, d: readers.json_lines(s, as_json_lines(_docs(s, d), "strict"), _DOC, "raise").groupBy("source").agg(F.count("*").alias("n")), "SELECT source, count(*) AS n FROM documents GROUP BY source")
add("snk01_json_round_trip", lambda s, d: s.read.schema(_DOC).json(as_json_lines(_docs(s, d), "back")), _BACK)


def _text_folder(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "text")
    read(s, d, "benchmark").select(F.concat(F.lit("  "), "text", F.lit(" \n\n")).alias("value")).write.text(path)
    return readers.text_lines(s, path)


add("src04_text_lines", _text_folder, f"SELECT {D.strip('x')} AS text FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM benchmark) WHERE {D.strip('x')} <> ''")
add("src09_whole_texts", lambda s, d: (lambda p: (read(s, d, "benchmark").repartition(4).select("text").write.text(p), readers.whole_texts(s, p + "/*.txt").agg(F.count("*").alias("files"), F.max(F.length("text") > 0).alias("full")))[1])(scratch(s, "whole")))


def _document(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "document")
    rows = read(s, d, "region").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("examples"))).alias("value"))
    rows.coalesce(1).write.text(path)
    return readers.json_document(s, path + "/*.txt").select(F.col("r_regionkey").cast("int").alias("r_regionkey"), "r_name")


add("src03_json_document", _document, "SELECT r_regionkey, r_name FROM region")


add("src01_dispatch", lambda s, d: readers.load(s, as_json_lines(_docs(s, d), "dispatch"), _DOC).agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM documents")


def _streamed(s: SparkSession, d: str) -> DataFrame:
    from ..streaming import monitor

    path = as_json_lines(_docs(s, d), "stream")
    stream = s.readStream.schema(_DOC).json(path).where("text <> ''").select("doc_id", F.size(T.plain_tokens(F.col("text"))).cast("long").alias("n"))
    return monitor.drain(stream, "src06_" + path[-14:-6], "append", scratch(s, "checkpoint"))


add("src06_lazy_stream", _streamed, f"SELECT doc_id, len({D.plain_tokens('text')}) AS n FROM documents WHERE text <> ''")
add("src08_worker_shards", lambda s, d: readers.worker_slice(_docs(s, d).withColumn("shard", F.pmod("doc_id", F.lit(16))), F.col("shard"), 1, 4).select("doc_id", "shard"), "SELECT doc_id, doc_id % 16 AS shard FROM documents WHERE doc_id % 16 % 4 = 1")


add("src15_weighted_streams", lambda s, d: corpus.fair_queue(_docs(s, d).where("text <> ''").select("doc_id", "source"), corpus._weights(s, d), "doc_id", drain=False).groupBy("source").agg(F.count("*").alias("n")), corpus.ORACLES["mix03_stop_at_dry"].replace("count(*) AS taken", "count(*) AS n"))
both("src19_projected_metadata", "SELECT doc_id AS example_id, lang, source FROM {documents}")


def _tar(s: SparkSession, d: str, edit: bool) -> str:
    """Documents as members of TAR files, one file a partition."""
    path = scratch(s, "tar")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as tar:
            for pdf in batches:
                for item, text in zip(pdf["item_id"], pdf["text"], strict=True):
                    members = {f"{item}.source.png": b"s", f"{item}.target.png": b"t", f"{item}.txt": text.encode()} if edit else {f"{item}.txt": text.encode(), f"{item}.png": bytes(4)}
                    for name, data in members.items():
                        info = tarfile.TarInfo(name)
                        info.size = len(data)
                        tar.addfile(info, io.BytesIO(data))
        yield pd.DataFrame({"data": [out.getvalue()]})

    read(s, d, "benchmark").repartition(3, "item_id").mapInPandas(pack, "data binary").write.parquet(path)
    return path


def _tar_rows(s: SparkSession, d: str, edit: bool) -> DataFrame:
    shards = s.read.parquet(_tar(s, d, edit)).withColumnRenamed("data", "content")
    samples = readers.pairs_of(shards) if edit else readers.samples_of(shards)
    return samples.withColumn("id", F.col("id").cast("long")).withColumnRenamed("id", "item_id")


add("src20_tar_samples", lambda s, d: _tar_rows(s, d, False).withColumn("image", F.hex("image")), "SELECT item_id, text, NULL::VARCHAR AS meta, '00000000' AS image FROM benchmark")
add("src34_edit_pairs", lambda s, d: _tar_rows(s, d, True).withColumns({"source": F.hex("source"), "target": F.hex("target")}), "SELECT item_id, text, '73' AS source, '74' AS target FROM benchmark")


def _box_files(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "boxes")
    rows = read(s, d, "lineitem").select(F.concat_ws(" ", F.pmod("l_suppkey", F.lit(4)), F.col("l_tax"), F.col("l_discount"), F.lit(0.5), F.lit(0.25), F.lit("extra")).alias("value"))
    rows.write.text(path)
    return readers.box_labels(s, path).groupBy("class").agg(F.count("*").alias("n"), F.round(F.sum("cx"), 6).alias("cx"))


add("src23_box_labels", _box_files, "SELECT CAST(l_suppkey % 4 AS INTEGER) AS class, count(*) AS n, round(sum(l_tax), 6) AS cx FROM lineitem GROUP BY 1")
add("src26_manifest", lambda s, d: s.read.schema("page_id long, url string").json(as_json_lines(read(s, d, "pages").select("page_id", "url"), "manifest")), "SELECT page_id, url FROM pages")


def _paths(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "paths")
    rows = read(s, d, "nation").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.concat(F.lit("clips/"), x["n_name"])), "\n").alias("x"))
    rows.select(F.concat(F.lit("path\n"), "x").alias("value")).coalesce(1).write.text(path)
    return readers.ordered_paths(s, path + "/*.txt")


add("src27_ordered_paths", _paths, "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS index, 'clips/' || n_name AS path FROM nation")
both("src28_benchmark_rows", "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS category, text AS question FROM {benchmark}")


def _metrics(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "csv")
    rows = read(s, d, "region").select(F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"), "r_regionkey")
    lines = rows.select((F.col("i") % 4).alias("step"), F.when(F.col("i") == 5, "nan").otherwise((F.col("i") * 10).cast("string")).alias("loss")).where("r_regionkey = 0").orderBy("i").coalesce(1)
    lines.write.option("header", "true").csv(path)
    return readers.csv_metrics(s, path, "step int, loss double", "step")


add("src30_last_metrics", _metrics, "SELECT * FROM (VALUES (0, 40.0::DOUBLE), (1, NULL::DOUBLE), (2, 60.0::DOUBLE), (3, 70.0::DOUBLE)) t(step, loss)")
add("src31_synthetic", lambda s, d: s.range(1000).select("id", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(100)).alias("a"), F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(100)).alias("b")).withColumn("question", F.concat(F.lit("What is "), "a", F.lit(" + "), "b", F.lit("?"))).withColumn("answer", F.col("a") + F.col("b")))

add("snk16_audit_log", lambda s, d: (lambda p: ([read(s, d, "region").select(F.lit(kind).alias("event"), F.col("r_name").alias("description")).write.mode("append").json(p) for kind in ("start", "end")], s.read.schema("event string, description string").json(p))[1])(scratch(s, "audit")), "SELECT event, r_name AS description FROM region, (VALUES ('start'), ('end')) e(event)")
add("arr01_slice_pad", lambda s, d: read(s, d, "benchmark").select("item_id", T.let(T.plain_tokens(F.col("text")), lambda t: F.array_join(F.concat(F.slice(t, 1, 6), F.array_repeat(F.lit("<pad>"), F.greatest(F.lit(8) - F.least(F.size(t), F.lit(6)), F.lit(0)))), " ")).alias("row")), f"SELECT item_id, array_to_string(list_concat(t[1:6], [('<pad>') FOR i IN range(8 - least(len(t), 6))]), ' ') AS row FROM (SELECT item_id, {D.plain_tokens('text')} AS t FROM benchmark)")
add("arr03_pair_round_trip", lambda s, d: (lambda c: c.withColumns({"swap": F.col("code").bitwiseAND(F.lit(32)) > 0, "index": F.col("code").bitwiseAND(F.lit(31))}).select("index", "swap", "a", "b").groupBy("index", "swap").agg(F.count_distinct("a", "b").alias("pairs")))(routing.pair_codes(routing.affine_routes(s, 512, 8, 2), 8).where("a <> b")).where("pairs > 1").agg(F.count("*").alias("clashes")), "SELECT 0::BIGINT AS clashes")
add("flt16_modality_dropout", lambda s, d: read(s, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("has")).withColumn("kept", F.filter("has", lambda m: F.pmod(F.xxhash64(m, "user_id"), F.lit(10)) >= 4)).select("user_id", F.when(F.size("kept") == 0, F.slice("has", 1, 1)).otherwise(F.col("kept")).alias("kept")))
both("met19_regression_gate", "WITH r AS (SELECT u.conv_id, u.turn, coalesce(a.text, '') AS response FROM {conversations} u LEFT JOIN {conversations} a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'), f AS (SELECT *, response = '' OR length(response) < 40 AS failed FROM r) SELECT count(*) AS prompts, CAST(sum(CASE WHEN failed THEN 1 ELSE 0 END) AS BIGINT) AS failures, 1 - avg(CASE WHEN failed THEN 1e0 ELSE 0e0 END) >= 0.9e0 AS passed FROM f")


def admission(events: DataFrame, batch: int, timeout: float) -> DataFrame:
    """A queue served in rounds of `batch`, first come first served; what waits longer than timeout at its admission has failed."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = events.withColumn("round", F.floor(place / batch)).withColumn("wait", F.col("round") * F.lit(1.0))
    return rows.select("event_id", "user_id", "round", F.when(F.col("wait") > timeout, "FAILED").otherwise("COMPLETED").alias("status"))


add("stm05_admission", lambda s, d: admission(read(s, d, "events"), 8, 5.0).groupBy("status").agg(F.count("*").alias("n")), "SELECT CASE WHEN r // 8 > 5 THEN 'FAILED' ELSE 'COMPLETED' END AS status, count(*) AS n FROM (SELECT row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r FROM events) GROUP BY 1")
add("tok08_token_statistics", lambda s, d: read(s, d, "documents").groupBy("lang").agg(F.sum(F.size(T.plain_tokens(F.col("text")))).alias("tokens"), F.sum(F.length("text")).alias("chars")), f"SELECT lang, CAST(sum(len({D.plain_tokens('text')})) AS BIGINT) AS tokens, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY lang")

QUERIES, ORACLES = BOOK.queries, BOOK.oracles
