"""Readers of the corpus formats: JSON lines, JSON documents, plain text, directories, token shards, TAR samples, box labels.

Records end at line feeds only; other line separators inside a string don't split one.  What a bad line does is an option of
each reader: "skip" drops it, "raise" stops with the path.
"""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.corpus import running_total
from ..operators.ordering import numbered


def _lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.option("lineSep", "\n")
    if glob:
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    return reader.text(path).withColumn("_path", F.col("_metadata.file_path"))


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str, bad: str = "raise", glob: str | None = None) -> DataFrame:
    """One record a line; blank lines are skipped; bad is "skip" or "raise"."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    rows = _lines(spark, path, glob).where(F.trim("value") != "")
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = rows.withColumn("r", F.from_json("value", wide, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    if bad == "skip":
        parsed = parsed.where("r is not null and r._bad is null")
    else:
        broken = F.raise_error(F.concat(F.lit("bad record in "), F.col("_path"), F.lit(": "), F.substring("value", 1, 80)))
        parsed = parsed.withColumn("r", F.when(F.col("r").isNull() | F.col("r._bad").isNotNull(), broken.cast(wide)).otherwise(F.col("r")))
    return parsed.select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields])


def json_document(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file with an array of records, or an object whose first of data, examples, items is one."""
    raw = spark.read.option("multiLine", "true").json(path)
    for field in ("data", "examples", "items"):
        if field in raw.columns and isinstance(raw.schema[field].dataType, T.ArrayType):
            return raw.select(F.inline(field))
    return raw


def text_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(text): a row for each line that isn't blank, stripped."""
    stripped = F.regexp_replace("value", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return _lines(spark, path, glob).select(stripped.alias("text")).where("text <> ''")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")


def directory(spark: SparkSession, path: str, schema: str = "text string") -> DataFrame:
    """All JSON lines and text files below a folder; columns that one kind lacks are null."""
    return json_lines(spark, path, schema, "skip", "*.jsonl").unionByName(text_lines(spark, path, "*.txt"), allowMissingColumns=True)


def load(spark: SparkSession, path: str, schema: str = "text string") -> DataFrame:
    """Dispatch by suffix: .jsonl, .json, .txt or .md; anything else is a folder if it has no suffix."""
    if path.endswith(".jsonl"):
        return json_lines(spark, path, schema)
    if path.endswith(".json"):
        return json_document(spark, path)
    if path.endswith((".txt", ".md")):
        return text_lines(spark, path)
    if "." in path.rstrip("/").rsplit("/", 1)[-1]:
        raise ValueError(f"no reader for {path}")
    return directory(spark, path, schema)


def worker_slice(df: DataFrame, index: Column, worker: int, workers: int) -> DataFrame:
    return df.where(F.pmod(index, F.lit(workers)) == worker)


# ---- token shards --------------------------------------------------------------------------------------------------

FORMAT = "granary-token-shard-v1"


def token_width(vocab: int) -> str:
    return "<u2" if vocab <= 65_535 else "<u4"


def write_token_shards(rows: DataFrame, path: str, vocab: int) -> None:
    """rows(shard, ids, ...) as a table of shards: little-endian bytes, counts, largest id and digest of each, other columns kept.

    A shard is a row, so its size is what the caller made it; a shard without tokens, or no shard at all, raises.
    """
    width = token_width(vocab)
    keep = [f for f in rows.schema.fields if f.name != "ids"]
    spec = T.StructType([*keep, *T._parse_datatype_string("format string, dtype string, n long, top long, data binary").fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held = [np.asarray(x, np.int64) for x in pdf["ids"]]
            if any(not len(x) for x in held):
                raise ValueError("a shard has no tokens")
            yield pdf.drop(columns="ids").assign(format=FORMAT, dtype=width, n=[len(x) for x in held], top=[int(x.max()) for x in held], data=[x.astype(width).tobytes() for x in held])

    packed = rows.select(*[f.name for f in keep], "ids").mapInPandas(run, spec)
    packed.withColumns({"bytes": F.length("data").cast("long"), "sha256": F.sha2("data", 256)}).write.mode("overwrite").parquet(path)
    if not rows.sparkSession.read.parquet(path).limit(1).count():
        raise ValueError("a shard has no tokens")


def _status() -> Column:
    """ok, or what is wrong with a shard's own row."""
    size = F.col("n") * F.when(F.col("dtype") == "<u2", 2).otherwise(4)
    return F.when(F.col("format") != FORMAT, "format").when(F.length("data") != size, "size").when(F.sha2("data", 256) != F.col("sha256"), "digest").otherwise("ok")


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """(shard, ..., ids) of a table of shards; wrong formats, counts or digests raise."""
    shards = spark.read.parquet(path)
    broken = F.raise_error(F.concat(F.lit("broken shard "), F.col("shard"), F.lit(": "), _status()))
    checked = shards.withColumn("data", F.when(_status() == "ok", F.col("data")).otherwise(broken.cast("binary")))
    keep = [f for f in shards.schema.fields if f.name not in {"format", "dtype", "n", "top", "data", "bytes", "sha256"}]
    spec = T.StructType([*keep, T.StructField("ids", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = [np.frombuffer(data, dtype).astype(np.int64) for dtype, data in zip(pdf["dtype"], pdf["data"], strict=True)]
            yield pdf.drop(columns=["dtype", "data"]).assign(ids=ids)

    return checked.select(*[f.name for f in keep], "dtype", "data").mapInPandas(run, spec)


LISTED = ("shard", "n", "top", "dtype", "bytes", "sha256")


def shard_index(spark: SparkSession, path: str, *by: str) -> DataFrame:
    """What a manifest says of each shard: (by..., shard, n, top, dtype, bytes, sha256); the tokens themselves aren't read."""
    return spark.read.parquet(path).select(*by, *LISTED)


def verify_shards(spark: SparkSession, path: str, index: DataFrame, *by: str) -> DataFrame:
    """(by..., shard, status) of the shards in an index: ok, missing, or the first that differs of size and digest."""
    held = spark.read.parquet(path).select(*by, "shard", F.length("data").cast("long").alias("_bytes"), F.sha2("data", 256).alias("_sha256"))
    rows = index.join(held, [*by, "shard"], "left")
    status = F.when(F.col("_bytes").isNull(), "missing").when(F.col("_bytes") != F.col("bytes"), "size").when(F.col("_sha256") != F.col("sha256"), "digest").otherwise("ok")
    return rows.select(*by, "shard", status.alias("status"))


def source_manifest(index: DataFrame, length: int, overlap: int = 1) -> DataFrame:
    """(source, shards, rows, tokens, bytes, files): rows of `length` tokens; of a shard's tokens `overlap` are the next one's first."""
    rows = F.floor((F.col("n") - overlap) / length)
    return index.groupBy("source").agg(F.count("*").alias("shards"), F.sum(rows).alias("rows"), F.sum("n").alias("tokens"), F.sum("bytes").alias("bytes"))


def manifest_faults(index: DataFrame, manifest: DataFrame, length: int, overlap: int = 1) -> DataFrame:
    """(source, fault): a row for each rule that an index(source, shard, n, dtype, bytes) and a manifest(source, shards, rows) break."""
    width = F.when(F.col("dtype") == "<u2", 2).otherwise(4)
    counted = index.groupBy("source").agg(
        F.count("*").alias("have"), F.count_distinct("shard").alias("names"), F.sum(F.floor((F.col("n") - overlap) / length)).alias("have_rows"),
        F.sum(F.when(F.col("bytes") != F.col("n") * width, 1).otherwise(0)).alias("wrong"), F.sum(F.when((F.col("n") - overlap) % length != 0, 1).otherwise(0)).alias("ragged"),
    )
    both = manifest.select("source", "shards", "rows").join(counted, "source", "full")
    faults = F.array_compact(F.array(
        F.when(F.col("have").isNull(), "no shards"), F.when(F.col("shards").isNull(), "not listed"), F.when(F.col("names") < F.col("have"), "names repeat"),
        F.when(F.col("have") != F.col("shards"), "listing incomplete"), F.when(F.col("have_rows") != F.col("rows"), "rows differ"), F.when(F.col("wrong") > 0, "bytes differ"), F.when(F.col("ragged") > 1, "tokens don't fit rows"),
    ))
    return both.select("source", F.explode(faults).alias("fault"))


def validated_mixture(spark: SparkSession, path: str, manifest: DataFrame, length: int, overlap: int = 1) -> DataFrame:
    """The shards (source, shard, ids) of a mixture whose manifest holds; a fault or a broken shard raises."""
    found = manifest_faults(shard_index(spark, path, "source"), manifest, length, overlap).limit(20).collect()
    if found:
        raise ValueError("; ".join(f"{r.source}: {r.fault}" for r in found))
    return read_token_shards(spark, path)


def fingerprint(index: DataFrame, *by: str) -> DataFrame:
    """(by..., shards, fingerprint): a digest of what the index says, in the order of shards, without reading a token."""
    line = F.concat_ws(":", F.col("shard").cast("string"), "dtype", F.col("n").cast("string"), F.col("top").cast("string"), "sha256")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("shard", line.alias("line")))), lambda x: x["line"]), "\n")
    return index.groupBy(*by).agg(F.count("*").alias("shards"), F.sha2(lines, 256).alias("fingerprint"))


# ---- samples in archives, box labels -------------------------------------------------------------------------------


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(content) of the files at a path."""
    return spark.read.format("binaryFile").load(path).select("content")


def tar_samples(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, meta, image): members id.txt, id.json and id.<picture> of TAR shards as one row for each id."""
    return samples_of(archives(spark, path))


def samples_of(shards: DataFrame) -> DataFrame:
    """tar_samples of a table (content) of shards."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                rows: dict[str, dict] = {}
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for member in tar:
                        if member.isfile():
                            name, _, kind = member.name.rpartition("/")[2].partition(".")
                            field = {"txt": "text", "json": "meta"}.get(kind, "image")
                            data = tar.extractfile(member).read()
                            rows.setdefault(name, {})[field] = data if field == "image" else data.decode("utf-8", "replace")
                yield pd.DataFrame([{"id": k, "text": v.get("text"), "meta": v.get("meta"), "image": v.get("image")} for k, v in rows.items()], columns=["id", "text", "meta", "image"])

    return shards.select("content").mapInPandas(run, "id string, text string, meta string, image binary")


def box_labels(spark: SparkSession, path: str) -> DataFrame:
    """(image, class, cx, cy, w, h) of label files with five fields a line; further fields and blank lines are ignored."""
    rows = _lines(spark, path).where(F.trim("value") != "").withColumn("f", F.split(F.trim("value"), r"\s+"))
    name = F.regexp_extract("_path", r"([^/]+)\.txt$", 1)
    return rows.select(name.alias("image"), F.col("f")[0].cast("int").alias("class"), *[F.col("f")[i].cast("double").alias(c) for i, c in enumerate(("cx", "cy", "w", "h"), 1)])


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def file_manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, bytes, sha256) of the files below a folder, as a table: nothing of it comes to the driver.

    A file's content passes through a task as one value, 2 GB at most.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return rows.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def release_manifest(spark: SparkSession, path: str, required: DataFrame, glob: str = "*") -> DataFrame:
    """(name, files, bytes, sha256) of the folders of a release; required(name) that have no file raise.

    The digest of a folder is that of its files' digests in order.
    """
    name = F.element_at(F.split(F.col("path"), "/"), -2)
    files = file_manifest(spark, path, glob).withColumn("name", name)
    listed = files.groupBy("name").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.array_sort(F.collect_list("sha256")).alias("all"))
    listed = listed.select("name", "files", "bytes", F.when(F.size("all") == 1, F.col("all")[0]).otherwise(F.sha2(F.array_join("all", ""), 256)).alias("sha256"))
    lacking = required.join(listed, "name", "left_anti").limit(20).collect()
    if lacking:
        raise ValueError(f"missing: {sorted(r.name for r in lacking)}")
    return listed


def _csv_cell(text: Column) -> Column:
    """Quoted where CSV needs it; null is nothing, an empty text is a pair of quotes."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.isNull(), "").when((text == "") | text.rlike('[,"\r\n]'), quoted).otherwise(text)


def _from_csv_cell(cell: Column) -> Column:
    inner = F.replace(F.substring(cell, F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"'))
    return F.when((F.length(cell) > 1) & cell.startswith('"') & cell.endswith('"'), inner).when(cell != "", cell)


def write_submission(predictions: DataFrame, paths: DataFrame, path: str) -> None:
    """One CSV file (path, prediction) in the order of paths(index, path); it is one file because its order is what it says.

    Predictions with an index belong to that line, so that lines may share a path; without one they belong to their path. A second
    prediction for a line or path raises. Tasks write the lines in parts; the driver appends the parts' bytes to each other.
    """
    spark = paths.sparkSession
    key = "index" if "index" in predictions.columns else "path"
    again = F.raise_error(F.concat(F.lit(f"predictions of one {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    single = predictions.groupBy(key).agg(F.count("*").alias("_n"), F.first("prediction").alias("prediction")).select(key, F.when(F.col("_n") == 1, F.col("prediction")).otherwise(again).alias("prediction"))
    rows = paths.join(single, key, "left").orderBy("index")
    rows = rows.select(F.concat(_csv_cell(F.col("path")), F.lit(","), F.coalesce(F.col("prediction").cast("string"), F.lit(""))).alias("value"))
    rows.write.mode("overwrite").option("compression", "none").text(f"{path}.parts")
    hadoop = spark._jvm.org.apache.hadoop
    parts, whole, target = (hadoop.fs.Path(p) for p in (f"{path}.parts", f"{path}.parts/_whole", path))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    files = {f.getPath().getName(): f.getPath() for f in fs.listStatus(parts) if f.getPath().getName().startswith("part-")}
    out = fs.create(whole, True)
    try:
        out.write(bytearray(b"path,prediction\n"))
        for name in sorted(files, key=lambda name: (int(name.split("-")[1]), name)):
            part = fs.open(files[name])
            try:
                hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            finally:
                part.close()
    finally:
        out.close()
    fs.delete(target, True)
    if not fs.rename(whole, target):
        raise OSError(f"{path} can't be written")
    fs.delete(parts, True)


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    """(index, path, prediction) of a submission's records, in their order.

    The file is read by blocks. A line after an odd number of quotes goes on with the record before it; blank lines are no records.
    """
    place = [F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row")]
    lines = numbered(spark.read.option("lineSep", "\n").text(path).select("value", *place), "_start", "_row", out="line").drop("_start", "_row")
    lines = running_total(lines.withColumn("_quotes", F.regexp_count("value", F.lit('"'))), [], "line", "_quotes", out="_opened")
    first = (F.col("_opened") % 2 == 0) & (F.trim(F.rtrim("value", F.lit("\r"))) != "")
    lines = running_total(lines.withColumn("_first", first.cast("int")), [], "line", "_first", out="_earlier").where("_first = 1 or _opened % 2 = 1")
    number = F.col("_earlier") + F.col("_first") - 2  # the header is -1
    record = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda p: p["value"]), "\n")
    records = lines.groupBy(number.cast("long").alias("index")).agg(F.rtrim(record, F.lit("\r")).alias("record")).where("index >= 0")
    last = F.when(F.contains("record", F.lit(",")), F.substring_index("record", ",", -1))
    cells = records.select("index", "record", last.alias("last"))
    head = F.when(F.col("last").isNull(), F.col("record")).otherwise(F.substring(F.col("record"), F.lit(1), F.length("record") - F.length("last") - 1))
    return cells.select("index", _from_csv_cell(head).alias("path"), _from_csv_cell(F.col("last")).try_cast("int").alias("prediction"))


def submission_faults(got: DataFrame, paths: DataFrame, classes: int) -> DataFrame:
    """(index, fault): lines that are missing, too many, in another order, or not a class."""
    both = paths.select("index", F.col("path").alias("want"), F.lit(True).alias("listed")).join(got.withColumn("given", F.lit(True)), "index", "full")
    fault = F.when(F.col("given").isNull(), "missing").when(F.col("listed").isNull(), "too many").when(~F.col("path").eqNullSafe(F.col("want")), "order")
    fault = fault.when(F.col("prediction").isNull() | ~F.col("prediction").between(0, classes - 1), "class")
    return both.select("index", fault.alias("fault")).where("fault is not null")


def coco_boxes(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, file_name, class, x, y, w, h) of a COCO document: images joined with annotations, category ids in order made dense."""
    doc = spark.read.option("multiLine", "true").json(path)
    images = doc.select(F.inline("images")).select(F.col("id").alias("image_id"), "file_name")
    dense = doc.select(F.transform(F.array_sort("categories.id"), lambda c: c).alias("ids"))
    boxes = doc.select(F.inline("annotations")).select("image_id", "category_id", "bbox")
    # one array of category ids a document
    known = boxes.crossJoin(F.broadcast(dense)).withColumn("class", (F.array_position("ids", F.col("category_id")) - 1).cast("int")).where("class >= 0")
    return known.join(images, "image_id").select("image_id", "file_name", "class", *[F.col("bbox")[i].alias(c) for i, c in enumerate("xywh")])


def indexed_examples(index: DataFrame, shards: DataFrame, template: str) -> DataFrame:
    """(example_id, ids) of an index(example_id, shard, offset, n, template_id) over shards(shard, ids).

    An example of another template, without its shard, or beyond its shard's end raises.
    """
    rows = index.join(shards, "shard", "left")
    fault = F.when(F.col("template_id") != template, "another template").when(F.col("ids").isNull(), "no shard").when(F.col("offset") + F.col("n") > F.size("ids"), "beyond the shard")
    wrong = F.raise_error(F.concat(F.lit("example "), F.col("example_id"), F.lit(": "), fault)).cast("array<bigint>")
    return rows.select("example_id", F.when(fault.isNotNull(), wrong).otherwise(F.slice("ids", (F.col("offset") + 1).cast("int"), F.col("n").cast("int"))).alias("ids"))


def listing(spark: SparkSession, path: str, attempts: int = 5) -> DataFrame:
    """(path, bytes) of the files below a folder; the listing is asked for again when it fails, a few times."""
    from ..records import with_retry

    read = lambda: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return with_retry(read, attempts).select("path", F.col("length").alias("bytes"))


def csv_metrics(spark: SparkSession, path: str, schema: str, step: str) -> DataFrame:
    """A CSV of metrics with one row for each step, the last one written; text that is no finite number is null."""
    kinds = T._parse_datatype_string(schema)
    raw = spark.read.option("header", "true").csv(path).withColumn("_line", F.monotonically_increasing_id())
    numbers = {f.name: F.col(f.name).try_cast(f.dataType) for f in kinds.fields}
    finite = {n: F.when(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), c) for n, c in numbers.items()}
    rows = raw.select("_line", *[c.alias(n) for n, c in finite.items()]).where(F.col(step).isNotNull())
    last = F.row_number().over(Window.partitionBy(step).orderBy(F.desc("_line")))
    return rows.withColumn("_r", last).where("_r = 1").drop("_r", "_line")


def safe_path(path: Column) -> Column:
    """Relative, not empty, without empty, . or .. parts."""
    return ~F.exists(F.split(path, "/"), lambda p: p.isin("", ".", ".."))


def ordered_paths(spark: SparkSession, path: str, header: str = "path") -> DataFrame:
    """(index, path) of a list that must keep its order: the header must be exact, paths safe and unique."""
    lines = spark.read.text(path, wholetext=True)
    rows = lines.select(F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), r"\r?\n")).alias("index", "path"))
    wrong = rows.where(((F.col("index") == 0) & (F.col("path") != header)) | ((F.col("index") > 0) & ~safe_path(F.col("path"))))
    if wrong.limit(1).count() or rows.groupBy("path").count().where("count > 1").limit(1).count():
        raise ValueError(f"{path} is no list of unique relative paths under the header {header}")
    return rows.where("index > 0").select((F.col("index") - 1).cast("long").alias("index"), "path")


def edit_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(id, source, target, text): members id.source.*, id.target.* and id.txt of TAR shards, complete ones only."""
    return pairs_of(archives(spark, path))


def pairs_of(shards: DataFrame) -> DataFrame:
    """edit_pairs of a table (content) of shards."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: dict[str, dict] = {}
            for content in pdf["content"]:
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for member in tar:
                        name, _, kind = member.name.rpartition("/")[2].partition(".")
                        role = kind.partition(".")[0]
                        field = {"source": "source", "target": "target", "txt": "text"}.get(role)
                        if member.isfile() and field:
                            data = tar.extractfile(member).read()
                            rows.setdefault(name, {})[field] = data.decode("utf-8", "replace") if field == "text" else data
            full = [{"id": k, **v} for k, v in rows.items() if len(v) == 3]
            yield pd.DataFrame(full, columns=["id", "source", "target", "text"])

    return shards.select("content").mapInPandas(run, "id string, source binary, target binary, text string")


def pending(candidates: DataFrame, uploaded: DataFrame) -> DataFrame:
    """(name, step, place) of complete candidates(name, complete) that uploaded(name) lacks, by the number they end on, -1 without one."""
    step = F.coalesce(F.regexp_extract("name", r"([0-9]+)$", 1).try_cast("long"), F.lit(-1).cast("long"))
    rows = candidates.where("complete").select("name").distinct().join(uploaded.select("name"), "name", "left_anti").withColumn("step", step)
    return numbered(rows, "step", "name", out="place")


def cached_counts(spark: SparkSession, path: str, identity: dict[str, object], compute: Callable[[], DataFrame]) -> DataFrame:
    """compute(), or what an earlier call left at path under the same identity; another identity replaces it."""
    mark = json.dumps(identity, sort_keys=True)
    try:
        held = spark.read.parquet(path)
        if held.limit(1).count() and not held.where(~F.col("_identity").eqNullSafe(F.lit(mark))).limit(1).count():
            return held.drop("_identity")
    except AnalysisException:  # nothing there yet
        pass
    compute().withColumn("_identity", F.lit(mark)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).drop("_identity")
