import csv
import hashlib
import io
import json
import tarfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from granary import catalog
from granary.sources import readers

from . import oracle


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_json_lines_split_at_line_feeds_only(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"text": "one two", "n": 1}\n\n  \n{"text": "three", "n": 2}\n', encoding="utf-8")
    assert rows(readers.json_lines(spark, str(path), "text string, n long")) == [("one two", 1), ("three", 2)]


def test_bad_lines_are_skipped_or_raise(spark, tmp_path):
    path = tmp_path / "b.jsonl"
    path.write_text('{"text": "x"}\n{broken\n{"text": "y"}\n')
    assert rows(readers.json_lines(spark, str(path), "text string", "skip")) == [("x",), ("y",)]
    with pytest.raises(Exception, match="bad record in .*b.jsonl"):
        readers.json_lines(spark, str(path), "text string").collect()


def test_json_documents(spark, tmp_path):
    for i, content in enumerate(([{"text": "a"}, {"text": "b"}], {"examples": [{"text": "a"}, {"text": "b"}]}, {"data": [{"text": "a"}, {"text": "b"}], "items": []})):
        path = tmp_path / f"{i}.json"
        path.write_text(json.dumps(content))
        assert rows(readers.load(spark, str(path)).select("text")) == [("a",), ("b",)]


def test_text_and_directories(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.txt").write_text(" one \n\n\ttwo\n")
    (tmp_path / "y.jsonl").write_text('{"text": "three"}\n{bad\n')
    assert rows(readers.load(spark, str(tmp_path / "sub" / "x.txt"))) == [("one",), ("two",)]
    assert rows(readers.load(spark, str(tmp_path))) == [("one",), ("three",), ("two",)]
    with pytest.raises(ValueError):
        readers.load(spark, "/tmp/file.xyz")


def test_token_shards_round_trip(spark, tmp_path):
    path = str(tmp_path / "shards")
    data = [("a", i, [j * 7000 for j in range(5 * i, 5 * i + 5)]) for i in range(2)]
    readers.write_token_shards(spark.createDataFrame(data, "source string, shard long, ids array<long>"), path, 70_000)
    assert rows(readers.read_token_shards(spark, path)) == sorted(data, key=str)
    assert [(r.n, r.top, r.bytes) for r in readers.shard_index(spark, path, "source").orderBy("shard").collect()] == [(5, 28_000, 20), (5, 63_000, 20)]
    assert readers.token_width(65_535) == "<u2" and readers.token_width(65_536) == "<u4"
    for column, value in (("n", F.lit(3).cast("long")), ("data", F.reverse("data")), ("format", F.lit("other"))):
        spark.read.parquet(path).withColumn(column, value if column != "data" else F.unhex(F.reverse(F.hex("data")))).write.mode("overwrite").parquet(path + "-broken")
        with pytest.raises(Exception, match="broken shard"):
            readers.read_token_shards(spark, path + "-broken").collect()
    spec = "source string, shard long, ids array<long>"
    for bad in ([], [("a", 0, [])]):
        with pytest.raises(Exception, match="no tokens"):
            readers.write_token_shards(spark.createDataFrame(bad, spec), path + "-empty", 10)


def test_manifest_faults_and_validated_mixture(spark, tmp_path):
    path = str(tmp_path / "shards")
    data = [("a", 0, list(range(9))), ("a", 1, list(range(8, 13))), ("b", 0, list(range(5)))]
    readers.write_token_shards(spark.createDataFrame(data, "source string, shard long, ids array<long>"), path, 100)
    index = readers.shard_index(spark, path, "source")
    manifest = readers.source_manifest(index, 4)
    assert rows(manifest.select("source", "shards", "rows", "tokens", "bytes")) == [("a", 2, 3, 14, 28), ("b", 1, 1, 5, 10)]
    assert rows(readers.validated_mixture(spark, path, manifest, 4)) == sorted(data, key=str)
    faults = lambda i, m: sorted(map(tuple, readers.manifest_faults(i, m, 4).collect()))
    assert faults(index, manifest) == []
    assert faults(index.where("source = 'a'"), manifest) == [("b", "no shards")]
    assert faults(index, manifest.where("source = 'a'")) == [("b", "not listed")]
    assert faults(index.where("source = 'b' or shard = 0"), manifest) == [("a", "listing incomplete"), ("a", "rows differ")]
    assert faults(index.withColumn("n", F.col("n") + 2), manifest) == [("a", "bytes differ"), ("a", "tokens don't fit rows"), ("b", "bytes differ")]
    with pytest.raises(ValueError, match="no shards"):
        readers.validated_mixture(spark, path, manifest.unionByName(manifest.limit(1).withColumn("source", F.lit("c"))), 4)


def test_indexed_examples_refuse_what_does_not_fit(spark):
    shards = spark.createDataFrame([(0, [1, 2, 3, 4])], "shard long, ids array<long>")
    make = lambda *r: spark.createDataFrame([r], "example_id long, shard long, offset long, n long, template_id string")
    assert readers.indexed_examples(make(7, 0, 1, 3, "t"), shards, "t").first().ids == [2, 3, 4]
    for row, match in (((7, 0, 1, 4, "t"), "beyond"), ((7, 1, 0, 1, "t"), "no shard"), ((7, 0, 0, 1, "u"), "another template")):
        with pytest.raises(Exception, match=match):
            readers.indexed_examples(make(*row), shards, "t").collect()


def test_submission_faults(spark, tmp_path):
    paths = spark.createDataFrame([(0, "b/1"), (1, "a/2"), (2, "c/3")], "index long, path string")
    path = str(tmp_path / "sub")
    readers.write_submission(spark.createDataFrame([("a/2", 1), ("b/1", 0), ("c/3", 2)], "path string, prediction int"), paths, path)
    assert rows(readers.read_submission(spark, path)) == [(0, "b/1", 0), (1, "a/2", 1), (2, "c/3", 2)]
    got = spark.createDataFrame([(0, "a/2", 1), (1, "a/2", None), (3, "x", 0)], "index long, path string, prediction int")
    assert rows(readers.submission_faults(got, paths, 3)) == [(0, "order"), (1, "class"), (2, "missing"), (3, "too many")]


def test_submission_keeps_lines_that_share_a_path_and_odd_paths(spark, tmp_path):
    odd = ["a", "b", "a", None, "", None, 'x,"y",1', "two\n\nlines, 3\r\n", '"', '""', '"q"', " s ", "back\\slash\\", "\r", "é\u2028", "a,", "a", "\n"]
    want = [(i, p, i % 7) for i, p in enumerate(odd * 40)]
    made = spark.createDataFrame(want, "index long, path string, prediction int")
    paths, path = made.select("index", "path"), str(tmp_path / "sub")
    readers.write_submission(made.select("index", "prediction"), paths, path)
    with open(path, newline="", encoding="utf-8") as file:
        assert list(csv.reader(file)) == [["path", "prediction"], *[[p or "", str(n)] for _, p, n in want]]
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for part in (size, "100"):  # whole, and by blocks that end within records
            spark.conf.set("spark.sql.files.maxPartitionBytes", part)
            got = readers.read_submission(spark, path)
            assert [tuple(r) for r in got.orderBy("index").collect()] == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert rows(readers.submission_faults(got, paths, 7)) == []
    assert rows(readers.submission_faults(got.where("index <> 3"), paths.where("index <> 5"), 7)) == [(3, "missing"), (5, "too many")]
    for twice in (made.select("path", "prediction"), made.select("index", "prediction").union(made.select("index", "prediction"))):
        with pytest.raises(Exception, match="predictions of one"):
            readers.write_submission(twice, paths, path + "-2")


def test_foreign_submission(spark, tmp_path):
    path = tmp_path / "sub.csv"
    path.write_bytes(b'\xef\xbb\xbfpath,prediction\r\na/1,3\r\n\r\n"b,2","4"\r\nc\r\nd,x\r\n\r\n  \n')
    assert rows(readers.read_submission(spark, str(path))) == [(0, "a/1", 3), (1, "b,2", 4), (2, "c", None), (3, "d", None)]


def test_submission_of_pages_with_one_url(spark, tmp_path):
    pages = [(i, ["u/1", None, "u,2", "u/1", "u/4"][i % 5], "") for i in range(120)]
    pd.DataFrame(pages, columns=["page_id", "url", "html"]).to_parquet(tmp_path / "pages.parquet", index=False)
    query, sql = catalog.queries()["snk09_submission"], catalog.oracle_sql()["snk09_submission"]
    assert oracle.difference(spark, query, sql, str(tmp_path), oracle.connect(str(tmp_path))) is None


def test_pending_cache_and_release(spark, tmp_path):
    have = spark.createDataFrame([("s-10", True), ("s-9", True), ("s-11", False), ("final", True), ("s-1", True)], "name string, complete boolean")
    assert [tuple(r) for r in readers.pending(have, spark.createDataFrame([("s-1",)], "name string")).orderBy("place").collect()] == [("final", -1, 0), ("s-9", 9, 1), ("s-10", 10, 2)]
    path = str(tmp_path / "cache")
    for identity, n, want in (("a", 3, 3), ("a", 5, 3), ("b", 5, 5), ("a", 2, 2)):
        assert readers.cached_counts(spark, path, {"id": identity}, lambda n=n: spark.range(n)).count() == want
    (tmp_path / "r" / "x").mkdir(parents=True)
    (tmp_path / "r" / "x" / "f.txt").write_text("abc")
    got = readers.release_manifest(spark, str(tmp_path / "r"), spark.createDataFrame([("x",)], "name string")).first()
    assert tuple(got) == ("x", 1, 3, hashlib.sha256(b"abc").hexdigest())
    with pytest.raises(ValueError, match="missing"):
        readers.release_manifest(spark, str(tmp_path / "r"), spark.createDataFrame([("y",)], "name string"))


def test_coco_boxes(spark, tmp_path):
    doc = {"images": [{"id": 5, "file_name": "f"}], "categories": [{"id": 9}, {"id": 2}], "annotations": [{"image_id": 5, "category_id": 9, "bbox": [1.0, 2.0, 3.0, 4.0]}, {"image_id": 6, "category_id": 2, "bbox": [1.0, 2.0, 3.0, 4.0]}, {"image_id": 5, "category_id": 4, "bbox": [1.0, 2.0, 3.0, 4.0]}]}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    assert rows(readers.coco_boxes(spark, str(tmp_path / "c.json"))) == [(5, "f", 1, 1.0, 2.0, 3.0, 4.0)]


def test_tar_samples(spark, tmp_path):
    with tarfile.open(tmp_path / "s.tar", "w") as tar:
        for name, data in (("a.txt", b"caption"), ("a.json", b"{}"), ("a.png", b"\x89"), ("b.txt", b"only")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    assert rows(readers.tar_samples(spark, str(tmp_path / "s.tar"))) == [("a", "caption", "{}", bytearray(b"\x89")), ("b", "only", None, None)]


def test_box_labels(spark, tmp_path):
    (tmp_path / "im1.txt").write_text("0 0.5 0.5 0.2 0.1\n\n2 .1 .1 .1 .1 0.9 extra\n")
    assert rows(readers.box_labels(spark, str(tmp_path))) == [("im1", 0, 0.5, 0.5, 0.2, 0.1), ("im1", 2, 0.1, 0.1, 0.1, 0.1)]


def test_manifest(spark, tmp_path):
    readers.write_json_lines(spark.range(3), str(tmp_path / "out"))
    listed = readers.file_manifest(spark, str(tmp_path / "out"), "*.json")
    assert listed.columns == ["path", "bytes", "sha256"] and listed.agg(F.sum("bytes")).first()[0] == 3 * len('{"id":0}\n')


def test_metrics_paths_and_edit_pairs(spark, tmp_path):
    (tmp_path / "m.csv").write_text("step,loss\n1,0.5\n2,nan\n1,0.25\nx,1\n3,inf\n")
    assert rows(readers.csv_metrics(spark, str(tmp_path / "m.csv"), "step int, loss double", "step")) == [(1, 0.25), (2, None), (3, None)]
    (tmp_path / "p.csv").write_text("path\nb/1\na/2\n")
    assert rows(readers.ordered_paths(spark, str(tmp_path / "p.csv"))) == [(0, "b/1"), (1, "a/2")]
    for bad in ("name\na\n", "path\n/abs\n", "path\na/../b\n", "path\na\na\n"):
        (tmp_path / "q.csv").write_text(bad)
        with pytest.raises(ValueError):
            readers.ordered_paths(spark, str(tmp_path / "q.csv"))
    with tarfile.open(tmp_path / "e.tar", "w") as tar:
        for name in ("1.source.png", "1.target.png", "1.txt", "2.source.png"):
            info = tarfile.TarInfo(name)
            info.size = 1
            tar.addfile(info, io.BytesIO(b"x"))
    assert rows(readers.edit_pairs(spark, str(tmp_path / "e.tar"))) == [("1", bytearray(b"x"), bytearray(b"x"), "x")]


def test_whole_texts(spark, tmp_path):
    (tmp_path / "w.txt").write_text("a\n\nb\n")
    assert rows(readers.whole_texts(spark, str(tmp_path / "w.txt"))) == [("a\n\nb\n",)]
