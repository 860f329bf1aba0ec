import duckdb
import numpy as np
import pytest
from pyspark.sql import types as T

from granary.llm import topk_search as tk

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("code", T.StringType()), T.StructField("rank", T.StringType())])


def codes_of(n, clustered):
    rng = np.random.default_rng(n)
    centres = rng.integers(0, 1 << 63, 8, np.uint64)
    noise = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (3, n)).astype(np.uint64))
    return np.unique(np.where(rng.random(n) < clustered, centres[rng.integers(0, 8, n)] ^ noise, rng.integers(0, 1 << 63, n, np.uint64)))


def search(codes, ids, queries, k):
    """All rounds over one block for each segment; (query, position, distance) and the number of verified codes."""
    cuts = tk.segments(len(codes))
    tables = [tk.CodeTable(codes, cuts, j) for j in range(len(cuts))]
    best, far, verified = (np.zeros(0, np.int64),) * 3, np.full(len(queries), tk.FAR), 0
    open_ = np.arange(len(queries))
    for radius in range(max(w for _, w in cuts) + 1):
        for table in tables:
            for who, at, distance, n in table.found(queries[open_], radius, far[open_]):
                verified += n
                best = tuple(np.concatenate(x) for x in zip(best, (open_[who], at, distance), strict=True))
        keep = tk.nearest(best[0], best[2], ids[best[1]], k)
        best = tuple(x[keep] for x in best)
        size = np.bincount(best[0], minlength=len(queries))
        far[:] = tk.FAR
        last = np.zeros(len(queries), np.int64)
        np.maximum.at(last, best[0], best[2])
        far[size == k] = last[size == k]
        open_ = open_[far[open_] >= len(cuts) * (radius + 1)]
        if not len(open_):
            break
    return best, verified


@pytest.mark.parametrize("n,k", [(5, 10), (300, 11), (5000, 4)])
def test_index_against_all_distances(n, k):
    codes = codes_of(n, 0.5)
    rng = np.random.default_rng(n)
    ids = rng.permutation(len(codes)) + 7
    queries = np.r_[codes[::9], rng.integers(0, 1 << 63, 20, np.uint64)]
    (q, at, distance), verified = search(codes, ids, queries, k)
    assert verified <= len(codes) * len(queries)  # no code is verified twice for a query
    for i, x in enumerate(queries):
        d = np.bitwise_count(codes ^ x)
        want = np.lexsort((ids, d))[:k]
        mine = np.flatnonzero(q == i)
        assert sorted(zip(distance[mine].tolist(), ids[at[mine]].tolist(), strict=True)) == sorted(zip(d[want].tolist(), ids[want].tolist(), strict=True))


def test_clustered_codes_are_mostly_not_verified():
    codes = codes_of(20_000, 1.0)
    _, verified = search(codes, np.arange(len(codes)), codes[::100], 11)
    assert verified < 0.2 * len(codes) * len(codes[::100])


def test_query_against_sql(spark):
    path = "/root/testdata/sf0.01"
    duckdb.sql(f"create or replace view embeddings as select * from '{path}/embeddings.parquet'")
    want = duckdb.sql(f"select query_id, rank, neighbor_id, distance from ({tk.ORACLE})").fetchall()
    assert sorted(tuple(r) for r in tk.query(spark, path).collect()) == sorted(want)


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(tk, "CODES", 40)
    monkeypatch.setattr(tk, "QUERIES", 3)
    monkeypatch.setattr(tk, "PIECE", 7)
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(64).tolist(), "c", "r") for i in range(120)]
    same = rng.standard_normal(64).tolist()
    rows += [(200 + i, same, "c", "r") for i in range(60)] + [(200, same, "c", "r"), (None, same, "c", "r"), (400, None, "c", "r"), (420, [], "c", "r"), (440, [None, 1.0], "c", "r")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = tk.top_k(df, df.where("vec_id % 20 = 0"), 5).collect()
    bits = {i: np.array([int((v[j] if j < len(v) else -1) is not None and j < len(v) and v[j] >= 0) for j in range(64)]) for i, v, *_ in rows if i is not None and v is not None}
    for q in {i for i in bits if i % 20 == 0}:
        want = sorted((int((bits[q] != b).sum()), i) for i, b in bits.items() if i != q)[:5]
        assert [(r.distance, r.neighbor_id) for r in sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)] == want
    empty = spark.createDataFrame([], SCHEMA)
    assert tk.top_k(empty, empty).collect() == []
    assert tk.top_k(df, empty).collect() == []
    with pytest.raises(Exception, match="64 bits"):
        tk.top_k(spark.createDataFrame([(1, [1.0] * 65, "", "")], SCHEMA), empty).collect()
