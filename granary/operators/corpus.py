"""Token counts, vocabularies, token streams, packing, mixtures and replay plans."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import twin as D
from ..dual import Book
from ..functions import text as T
from ..session import materialised
from .ordering import numbered, numbered_within

BOOK = Book()
read = lambda spark, sf_dir, name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- operators -----------------------------------------------------------------------------------------------------


def token_rows(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """A row (keep..., pos, token) for each token."""
    return docs.select(*keep, F.posexplode(T.plain_tokens(F.col(text))).alias("pos", "token"))


def frequencies(docs: DataFrame, stride: int = 0, key: str = "doc_id") -> DataFrame:
    """(token, cnt) of the training part: every stride-th row is held out; exact 64-bit counts, summed map-side first."""
    if stride:
        docs = docs.where(F.pmod(F.col(key), F.lit(stride)) != 0)
    words = docs.select(F.explode(F.split(F.lower("text"), rf"[{T.SPACE}]+")).alias("token")).where("token <> ''")  # plain_tokens, empty ones dropped as rows
    return words.groupBy("token").agg(F.count("*").alias("cnt"))


def vocabulary(counts: DataFrame, specials: int = 0) -> DataFrame:
    """(token, cnt, token_id): ids by falling count, ties by token, after the special ids.

    Tokens are dealt by ranges of (count, token) and numbered within them, so that neither the whole vocabulary nor the many words
    that occur once are a task's work.
    """
    return numbered(counts, F.desc("cnt"), "token").select("token", "cnt", (F.col("position") + specials).alias("token_id"))


#: Tokens of a vocabulary up to this number are broadcast to encode and decode with (some 40 MB); beyond it the join is shuffled.
BROADCAST_TOKENS = 1_000_000


def _small(vocab: DataFrame) -> DataFrame:
    """token and token_id, broadcast if the vocabulary is small enough: no frequent token then gathers its rows in a task."""
    vocab = materialised(vocab.select("token", "token_id"), "vocabulary")
    return F.broadcast(vocab) if vocab.count() <= BROADCAST_TOKENS else vocab


def zipf_weights(vocab: DataFrame, alpha: float = 0.5, floor: float = 0.05) -> DataFrame:
    """Weight max((rank / V)^alpha, floor) by falling frequency, scaled to a root mean square of 1."""
    vocab = materialised(vocab, "vocabulary")
    size, = vocab.agg(F.count("*")).first()
    raw = F.greatest(F.pow((F.col("token_id") + 1) / F.lit(float(max(1, size))), F.lit(alpha)), F.lit(floor))
    weighted = vocab.withColumn("raw", raw)
    norm, = weighted.agg(F.sqrt(F.avg(F.col("raw") * F.col("raw")))).first()
    return weighted.select("token", "cnt", (F.col("token_id") + 1).alias("rank"), F.round(F.col("raw") / F.lit(norm or 1.0), 6).alias("weight"))


def encode(docs: DataFrame, vocab: DataFrame, unknown: int = 0, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep..., ids): token ids in order; tokens that the vocabulary lacks are `unknown`."""
    rows = token_rows(docs, key, *keep).join(_small(vocab), "token", "left")
    pairs = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("token_id", F.lit(unknown)).alias("id"))))
    return rows.groupBy(key, *keep).agg(F.transform(pairs, lambda p: p["id"]).alias("ids"))


def decode(encoded: DataFrame, vocab: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text): the tokens of ids joined by spaces."""
    rows = encoded.select(key, F.posexplode("ids").alias("pos", "token_id")).join(_small(vocab), "token_id")
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda p: p["token"]), " ").alias("text"))


def running_total(rows: DataFrame, keys: list[str], order: str, size: str, width: int = 4096, out: str = "before") -> DataFrame:
    """Adds the sum of size over all earlier rows of the same keys by order, an integer column.

    Two phases: totals of blocks of `width` order values are summed over blocks, rows only within their block, so that a key
    that holds most of the rows is still spread over its blocks.  Rows without a key are a key of their own.
    """
    blocked = rows.withColumn("_block", F.floor(F.col(order) / width))
    totals = blocked.groupBy(*keys, "_block").agg(F.sum(size).alias("_total"))
    base = F.coalesce(F.sum("_total").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = F.coalesce(F.sum(size).over(Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by = [*keys, "_block"]
    base = totals.select(*[F.col(k).alias(f"_by_{i}") for i, k in enumerate(by)], base.alias("_base"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_by_{i}")) for i, k in enumerate(by)])
    return blocked.withColumn("_inner", inner).join(base, same).withColumn(out, F.col("_base") + F.col("_inner")).drop("_block", "_base", "_inner", *[f"_by_{i}" for i in range(len(by))])


def laid_out(docs: DataFrame, eos: str | None = "<eos>", key: str = "doc_id") -> DataFrame:
    """(source, before, n, tokens): a row for each document with tokens, all of a source end to end by key, each followed by eos if given."""
    tokens = T.plain_tokens(F.col("text"))
    if eos:
        tokens = F.concat(tokens, F.array(F.lit(eos)))
    rows = docs.select("source", key, tokens.alias("tokens")).where(F.size("tokens") > (1 if eos else 0)).withColumn("n", F.size("tokens").cast("long"))
    return placed(rows, key)


def placed(rows: DataFrame, key: str) -> DataFrame:
    """(source, before, n, tokens) of rows(source, key, n, tokens): adds the tokens of the source that come before."""
    return running_total(rows, ["source"], key, "n").select("source", "before", "n", "tokens")


def pieces(stream: DataFrame, length: int, overlap: int = 0) -> DataFrame:
    """(source, window, at, n, part): the part of each document in each window of length + overlap tokens every `length`.

    A document gives a row for each window that it touches, not one for each token; at is the position of the part's first token.
    """
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col("before") - overlap) / length))
    last = F.floor((F.col("before") + F.col("n") - 1) / length)
    rows = stream.select("source", "before", "n", "tokens", F.explode(F.sequence(first, last)).alias("window"))
    start = F.greatest("before", F.col("window") * length)
    end = F.least(F.col("before") + F.col("n"), F.col("window") * length + length + overlap)
    rows = rows.withColumns({"at": start, "size": end - start}).where("size > 0")
    return rows.select("source", "window", "at", F.col("size").alias("n"), F.slice("tokens", (F.col("at") - F.col("before") + 1).cast("int"), F.col("size").cast("int")).alias("part"))


def windows(stream: DataFrame, length: int, overlap: int = 0, keep_tail: bool = False) -> DataFrame:
    """(source, window, n, text): windows of length + overlap tokens every `length` of a stream that is laid out; a short last one only with keep_tail."""
    parts = pieces(stream, length, overlap).withColumn("part", F.array_join("part", " "))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda p: p["part"]), " ")
    out = parts.groupBy("source", "window").agg(F.sum("n").alias("n"), text.alias("text"))
    return out if keep_tail else out.where(F.col("n") == length + overlap)


def next_fit(rows: DataFrame, group: str, order: str, size: str, capacity: int, separator: int = 1) -> DataFrame:
    """(group, order, size, pack): items in order go into the open pack while they and a separator fit, or open the next one.

    The recurrence is sequential within a group; groups are folded one row at a time from a sorted stream, so that a group of
    any size takes constant memory.  Items over the capacity have a pack of their own.
    """
    rows = rows.select(F.col(group).cast("string").alias("g"), F.col(order).cast("long").alias("o"), F.col(size).cast("long").alias("s"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, pack, used = None, -1, 0
        for pdf in batches:
            packs = []
            for g, s in zip(pdf["g"], pdf["s"], strict=True):
                if g != now or pack < 0:
                    now, pack, used = g, 0, s
                elif used + separator + s <= capacity:
                    used += separator + s
                else:
                    pack, used = pack + 1, s
                packs.append(pack)
            yield pdf.assign(pack=packs)

    out = rows.repartition(n, "g").sortWithinPartitions("g", "o").mapInPandas(fold, "g string, o long, s long, pack long")
    return out.toDF(group, order, size, "pack")


def fair_queue(rows: DataFrame, sources: DataFrame, order: str, drain: bool = True) -> DataFrame:
    """rows(source, ...) with key, the virtual time k / weight of the k-th row of a source, and the source's position.

    Taking rows by (key, position) is the weighted fair queue; without drain it ends before the first row that a source which
    has run dry would have given.  sources: (source, weight, position), one row each.
    """
    out = numbered_within(rows, ["source"], order, out="k").join(sources, "source").withColumn("key", F.col("k") / F.col("weight"))
    if drain:
        return out
    ends = rows.groupBy("source").agg(F.count("*").alias("n")).join(sources, "source", "right")
    dry = ends.agg(F.min(F.struct((F.coalesce("n", F.lit(0)) / F.col("weight")).alias("key"), "position")).alias("dry"))
    return out.join(F.broadcast(dry)).where(F.struct("key", "position") < F.col("dry")).drop("dry")


def apportion(weights: DataFrame, total: int, name: str = "source", weight: str = "weight") -> DataFrame:
    """Adds count: total split by weight, whole parts first, then one each to the largest remainders, ties by name."""
    exact = F.col(weight) * F.lit(total)
    rows = weights.withColumn("_whole", F.floor(exact).cast("long")).withColumn("_rest", exact - F.col("_whole"))
    left = F.lit(total) - F.sum("_whole").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.desc("_rest"), name))
    return rows.withColumn("count", (F.col("_whole") + F.when(rank <= left, 1).otherwise(0)).cast("long")).drop("_whole", "_rest")


def mixture_faults(sources: DataFrame) -> DataFrame:
    """A row (fault) for each rule that a mixture (name, weight, dataset_id, data_files) breaks."""
    one = sources.agg(
        F.when(F.count("*") == 0, "empty").alias("a"), F.when(F.count("*") != F.count_distinct("name"), "duplicate names").alias("b"),
        F.when(F.count(F.when(~F.coalesce((F.col("weight") > 0) & (F.col("weight") <= 1), F.lit(False)), 1)) > 0, "weight out of range").alias("c"),
        F.when(F.abs(F.coalesce(F.sum("weight"), F.lit(0.0)) - 1) > 1e-9, "weights do not sum to 1").alias("d"),
        F.when(F.count(F.when(F.col("dataset_id").isNull() == F.col("data_files").isNull(), 1)) > 0, "needs exactly one of dataset and files").alias("e"),
    )
    return one.select(F.explode(F.array_compact(F.array("a", "b", "c", "d", "e"))).alias("fault"))


def layout(budget: int, length: int, batch: int, weights: dict[str, float]) -> tuple[int, int, dict[str, int]]:
    """(rows, tokens, rows of each source): the budget in rows, rounded up to whole batches, split by largest remainder in batches."""
    rows = -(-budget // length)
    rows = -(-rows // batch) * batch
    whole = {n: int(rows * w) for n, w in weights.items()}
    rest = sorted(weights, key=lambda n: (-(rows * weights[n] - whole[n]), n))
    for n in rest[: rows - sum(whole.values())]:
        whole[n] += 1
    return rows, rows * length, whole


def pick_shards(shards: DataFrame, budget: Column) -> DataFrame:
    """Best-scored shards of each source up to a budget of rows, the last one in part; adds taken."""
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("source").orderBy(F.desc("score"), "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = shards.withColumn("before", before).withColumn("taken", F.least(F.col("rows"), budget - F.col("before")))
    return out.where("taken > 0").drop("before")


def parse_tokens(x: Column) -> Column:
    """A budget like 70B, 1.5 M or 2_000 as a number; null if it is none."""
    bare = F.lower(F.regexp_replace(x, r"[_\s]", ""))
    number = F.regexp_extract(bare, r"^([0-9]+(?:\.[0-9]+)?)[kmbt]?$", 1).try_cast("double")
    unit = F.regexp_extract(bare, r"([kmbt]?)$", 1)
    scale = F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "b", 1e9).when(unit == "t", 1e12).otherwise(1.0)
    return F.round(number * scale).cast("long")


# ---- queries -------------------------------------------------------------------------------------------------------

LEN = "CAST(len(" + D.plain_tokens("text") + ") AS BIGINT)"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", "source", "lang", F.size(T.plain_tokens(F.col("text"))).cast("long").alias("n"))


SIZED = f"WITH sized AS (SELECT doc_id, source, lang, {LEN} AS n FROM documents)"
_FREQ = f"freq AS (SELECT token, count(*) AS cnt FROM (SELECT unnest({D.plain_tokens('text')}) AS token FROM documents WHERE doc_id % 10 <> 0) GROUP BY token)"
_VOCAB = f"WITH {_FREQ}, vocab AS (SELECT token, cnt, row_number() OVER (ORDER BY cnt DESC, token) - 1 AS token_id FROM freq)"

BOOK.add("agg01_token_frequencies", lambda s, d: frequencies(_docs(s, d), 10), f"WITH {_FREQ} SELECT token, cnt FROM freq")
BOOK.add("agg02_corpus_counters", lambda s, d: _docs(s, d).where("doc_id % 10 <> 0").agg(F.count("*").alias("documents"), F.sum(F.size(T.plain_tokens(F.col("text")))).alias("tokens")).crossJoin(frequencies(_docs(s, d), 10).agg(F.count("*").alias("vocabulary"))), f"WITH {_FREQ} SELECT (SELECT count(*) FROM documents WHERE doc_id % 10 <> 0) AS documents, CAST(sum(cnt) AS BIGINT) AS tokens, count(*) AS vocabulary FROM freq")
BOOK.add("agg03_tokens_per_source", lambda s, d: _docs(s, d).select("source", F.size(T.plain_tokens(F.col("text"))).alias("n"), F.length("text").alias("c")).rollup("source").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"), F.sum("c").alias("chars"), F.round(F.sum("n") / F.sum("c"), 9).alias("per_char")), f"SELECT source, count(*) AS docs, CAST(sum({LEN}) AS BIGINT) AS tokens, CAST(sum(length(text)) AS BIGINT) AS chars, round(sum({LEN}) / sum(length(text)), 9) AS per_char FROM documents GROUP BY ROLLUP (source)")
BOOK.add("win20_zipf_weights", lambda s, d: zipf_weights(vocabulary(frequencies(_docs(s, d), 10))), f"WITH {_FREQ}, vocab AS MATERIALIZED (SELECT token, cnt, row_number() OVER (ORDER BY cnt DESC, token) AS rank FROM freq), size AS (SELECT CAST(count(*) AS DOUBLE) AS v FROM vocab), raw AS MATERIALIZED (SELECT token, cnt, rank, greatest(pow(rank / v, 0.5), 0.05::DOUBLE) AS raw FROM vocab, size), norm AS (SELECT sqrt(avg(raw * raw)) AS z FROM raw) SELECT token, cnt, rank, round(raw / z, 6) AS weight FROM raw, norm")
BOOK.add("tok01_encode", lambda s, d: encode(_docs(s, d), vocabulary(frequencies(_docs(s, d), 10), 3)).select("doc_id", F.size("ids").cast("long").alias("n"), F.array_join("ids", " ").alias("ids")), f"{_VOCAB} SELECT doc_id, count(*) AS n, string_agg(CAST(coalesce(token_id + 3, 0) AS VARCHAR), ' ' ORDER BY pos) AS ids FROM (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM (SELECT doc_id, {D.plain_tokens('text')} AS t FROM documents)) LEFT JOIN vocab USING (token) GROUP BY doc_id")
BOOK.add("tok02_decode", lambda s, d: (lambda v: decode(encode(_docs(s, d).where("doc_id % 10 <> 0"), v), v))(vocabulary(frequencies(_docs(s, d), 10))), f"SELECT doc_id, array_to_string({D.plain_tokens('text')}, ' ') AS text FROM documents WHERE doc_id % 10 <> 0")
BOOK.add("tok09_flatten_with_eos", lambda s, d: read(s, d, "benchmark").select("item_id", F.concat(T.plain_tokens(F.col("text")), F.array(F.lit("<eos>"))).alias("t")).select("item_id", F.array_join("t", " ").alias("flat"), F.size("t").cast("long").alias("n")), f"SELECT item_id, array_to_string(list_append({D.plain_tokens('text')}, '<eos>'), ' ') AS flat, len({D.plain_tokens('text')}) + 1 AS n FROM benchmark")
BOOK.add("tok11_extend_vocabulary", lambda s, d: (lambda base, more: numbered(more.join(base, "token", "left_anti"), F.desc("cnt"), "token").select("token", (F.col("position") + 1).alias("new_id")))(frequencies(_docs(s, d).where("lang = 'en'")), frequencies(_docs(s, d).where("lang = 'fr'")).where("cnt > 3")), f"WITH w AS (SELECT lang, unnest({D.plain_tokens('text')}) AS token FROM documents), more AS (SELECT token, count(*) AS cnt FROM w WHERE lang = 'fr' GROUP BY 1 HAVING count(*) > 3) SELECT token, row_number() OVER (ORDER BY cnt DESC, token) AS new_id FROM more WHERE token NOT IN (SELECT token FROM w WHERE lang = 'en')")
BOOK.add("set06_merge_vocabulary", lambda s, d: (lambda base, other: other.join(base, "token", "left_anti").select("token"))(frequencies(_docs(s, d).where("lang = 'de'")), frequencies(_docs(s, d).where("lang = 'es'"))), f"WITH w AS (SELECT lang, unnest({D.plain_tokens('text')}) AS token FROM documents) SELECT DISTINCT token FROM w WHERE lang = 'es' AND token NOT IN (SELECT token FROM w WHERE lang = 'de')")
BOOK.both("tok10_id_width", "SELECT vocab, CASE WHEN vocab <= 65535 THEN 'uint16' ELSE 'uint32' END AS shard_type, CASE WHEN vocab <= 65536 THEN 'uint16' ELSE 'uint32' END AS mixture_type FROM (SELECT 65530 + o_orderkey AS vocab FROM {orders} WHERE o_orderkey <= 12) x")

_STREAM = f"""pieces AS (SELECT source, doc_id, list_append({D.plain_tokens('text')}, '<eos>') AS t FROM documents WHERE len({D.plain_tokens('text')}) > 0),
    placed AS (SELECT source, t, coalesce(sum(len(t)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pieces),
    stream AS (SELECT source, CAST(before + generate_subscripts(t, 1) - 1 AS BIGINT) AS position, unnest(t) AS token FROM placed)"""
_WIN = "SELECT source, CAST(w AS BIGINT) AS window, count(*) AS n, sha256(string_agg(token, ' ' ORDER BY position)) AS digest FROM"
_hashed = lambda df: df.select("source", "window", "n", F.sha2("text", 256).alias("digest"))
BOOK.add("pck01_batch_pack", lambda s, d: _hashed(windows(laid_out(_docs(s, d)), 128, keep_tail=True)), f"WITH {_STREAM} {_WIN} (SELECT *, position // 128 AS w FROM stream) GROUP BY source, w")
BOOK.add("pck02_stream_pack", lambda s, d: _hashed(windows(laid_out(_docs(s, d)), 128)), f"WITH {_STREAM} {_WIN} (SELECT *, position // 128 AS w FROM stream) GROUP BY source, w HAVING count(*) = 128")
BOOK.add("pck03_lm_windows", lambda s, d: _hashed(windows(laid_out(_docs(s, d)), 128, 1)), f"WITH {_STREAM} {_WIN} (SELECT *, position // 128 AS w FROM stream UNION ALL SELECT *, position // 128 - 1 FROM stream WHERE position % 128 = 0 AND position > 0) GROUP BY source, w HAVING count(*) = 129")
BOOK.add("pck04_offline_pack", lambda s, d: _hashed(windows(laid_out(_docs(s, d), None), 100, keep_tail=True)), f"WITH {_STREAM.replace("list_append(" + D.plain_tokens('text') + ", '<eos>')", D.plain_tokens('text'))} {_WIN} (SELECT *, position // 100 AS w FROM stream) GROUP BY source, w")
BOOK.add("snk04_rolling_shards", lambda s, d: pieces(laid_out(_docs(s, d)), 1024, 1).groupBy("source", F.col("window").alias("shard")).agg(F.sum("n").alias("tokens"), F.min("at").alias("first"), F.max(F.col("at") + F.col("n") - 1).alias("last")), f"WITH {_STREAM} SELECT source, CAST(w AS BIGINT) AS shard, count(*) AS tokens, min(position) AS first, max(position) AS last FROM (SELECT *, position // 1024 AS w FROM stream UNION ALL SELECT *, position // 1024 - 1 FROM stream WHERE position % 1024 = 0 AND position > 0) GROUP BY source, w")
BOOK.add("snk08_fixed_width", lambda s, d: laid_out(_docs(s, d)).groupBy("source").agg(F.sum("n").alias("total")).where("total >= 64").select("source", F.expr("total div 64 * 64").alias("kept"), "total"), f"WITH {_STREAM} SELECT source, (count(*) // 64) * 64 AS kept, count(*) AS total FROM stream GROUP BY source HAVING count(*) >= 64")
BOOK.add("src11_lm_reader", lambda s, d: windows(laid_out(_docs(s, d)), 128, 1).where("window >= 2").groupBy("source").agg(F.count("*").alias("windows"), F.min("window").alias("first")), f"WITH {_STREAM}, n AS (SELECT source, (count(*) - 1) // 128 AS w FROM stream GROUP BY source) SELECT source, w - 2 AS windows, 2::BIGINT AS first FROM n WHERE w > 2")
BOOK.add("srt03_tail_split", lambda s, d: _sized(s, d).groupBy("source").agg(F.sum(F.col("n") + 1).alias("n")).withColumn("held", F.least(F.greatest(F.lit(129), F.floor(F.col("n") * 0.02)), F.greatest(F.lit(129), F.floor(F.col("n") / 10)))).select("source", "n", F.col("held").cast("long").alias("held")), f"{SIZED} SELECT source, n, CAST(least(greatest(129, floor(n * 0.02::DOUBLE)), greatest(129, floor(n / 10))) AS BIGINT) AS held FROM (SELECT source, CAST(sum(n + 1) AS BIGINT) AS n FROM sized GROUP BY source)")
BOOK.add("pck05_next_fit", lambda s, d: next_fit(_sized(s, d).where("n > 0"), "source", "doc_id", "n", 2048).groupBy("source", "pack").agg(F.count("*").alias("items"), F.sum("n").alias("tokens")))
BOOK.add("pck06_pad_collate", lambda s, d: _sized(s, d).withColumn("batch", F.floor(F.col("doc_id") / 16)).withColumn("width", F.max("n").over(Window.partitionBy("batch"))).select("doc_id", "batch", "n", (F.col("width") - F.col("n")).alias("padding")), f"{SIZED} SELECT doc_id, doc_id // 16 AS batch, n, max(n) OVER (PARTITION BY doc_id // 16) - n AS padding FROM sized")
BOOK.add("pck09_keep_last", lambda s, d: _docs(s, d).select("doc_id", T.let(T.plain_tokens(F.col("text")), lambda t: F.array_join(F.slice(t, F.greatest(F.size(t) - 15, F.lit(1)), F.lit(16)), " ")).alias("tail")), f"SELECT doc_id, array_to_string(t[greatest(len(t) - 15, 1):], ' ') AS tail FROM (SELECT doc_id, {D.plain_tokens('text')} AS t FROM documents)")
BOOK.add("srt11_length_batches", lambda s, d: numbered_within(_sized(s, d), ["source"], "n", "doc_id", out="r").select("doc_id", "source", F.floor(F.col("r") / 8).alias("batch")), f"{SIZED} SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY n, doc_id) - 1) // 8 AS batch FROM sized")
BOOK.both("pck14_source_exposures", "SELECT source, count(*) AS items, count(*) * 3 AS exposures, CAST(sum(count(*) * 3) OVER () AS BIGINT) AS total FROM {documents} GROUP BY source")

# mixtures: weight of a source is falling with its position
_W = "src AS (SELECT source, position, w / sum(w) OVER () AS weight FROM (SELECT source, position, 1e0 / (1 + position) AS w FROM (SELECT source, CAST(row_number() OVER (ORDER BY source) - 1 AS INT) AS position FROM (SELECT DISTINCT source FROM {documents}) a) b) c)"


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _docs(spark, sf_dir).select("source").distinct().withColumn("position", F.row_number().over(Window.orderBy("source")) - 1)
    raw = names.withColumn("w", F.lit(1.0) / (1 + F.col("position")))
    return raw.select("source", "position", (F.col("w") / F.sum("w").over(Window.partitionBy())).alias("weight"))


_QUEUE = f"WITH {_W}, q AS (SELECT doc_id, source, position, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / weight AS key FROM {{documents}} JOIN src USING (source))"
BOOK.add("mix02_fair_queue", lambda s, d: fair_queue(_docs(s, d).select("doc_id", "source"), _weights(s, d), "doc_id").select("doc_id", "source", F.round("key", 6).alias("key"), "position"), f"{_QUEUE} SELECT doc_id, source, round(key, 6) AS key, position FROM q")
BOOK.add("mix03_stop_at_dry", lambda s, d: fair_queue(_docs(s, d).select("doc_id", "source"), _weights(s, d), "doc_id", drain=False).groupBy("source").agg(F.count("*").alias("taken")), f"{_QUEUE}, dry AS (SELECT min((count / weight, position)) AS d FROM (SELECT source, count(*) AS count FROM documents GROUP BY source) JOIN src USING (source)) SELECT source, count(*) AS taken FROM q, dry WHERE (key, position) < d GROUP BY source")
BOOK.add("mix04_drain_all", lambda s, d: fair_queue(_docs(s, d).select("doc_id", "source"), _weights(s, d), "doc_id").groupBy("source").agg(F.count("*").alias("taken"), F.round(F.max("key"), 6).alias("last")), f"{_QUEUE} SELECT source, count(*) AS taken, round(max(key), 6) AS last FROM q GROUP BY source")
BOOK.add("mix06_interleave", lambda s, d: _docs(s, d).select("doc_id", "source", F.xxhash64(F.lit(1), "doc_id").alias("place")))
BOOK.add("mix05_weighted_interleave", lambda s, d: fair_queue(_docs(s, d).select("doc_id", "source"), _weights(s, d), "doc_id").select("doc_id", (-F.log((F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30)) + 1) / float(1 << 30)) / F.col("weight")).alias("place")))
BOOK.add("win11_apportionment", lambda s, d: apportion(_weights(s, d), 100_003).select("source", "count"), f"WITH {_W}, e AS (SELECT source, weight * 100003 AS x FROM src), f AS (SELECT source, CAST(floor(x) AS BIGINT) AS whole, x - floor(x) AS rest FROM e) SELECT source, CAST(whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, source) <= 100003 - (SELECT sum(whole) FROM f) THEN 1 ELSE 0 END AS BIGINT) AS count FROM f")
BOOK.add("mix07_layout", lambda s, d: apportion(_weights(s, d), 4096).select("source", (F.col("count") * 32).alias("rows")), f"WITH {_W}, e AS (SELECT source, weight * 4096 AS x FROM src), f AS (SELECT source, CAST(floor(x) AS BIGINT) AS whole, x - floor(x) AS rest FROM e) SELECT source, CAST(whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, source) <= 4096 - (SELECT sum(whole) FROM f) THEN 1 ELSE 0 END AS BIGINT) * 32 AS rows FROM f")
BOOK.add("mix01_mixture_faults", lambda s, d: mixture_faults(read(s, d, "nation").select(F.lit("a").alias("name"), (F.col("n_nationkey") / 300.0).alias("weight"), F.lit("x").alias("dataset_id"), F.lit("y").alias("data_files"))), "SELECT * FROM (VALUES ('duplicate names'), ('weight out of range'), ('needs exactly one of dataset and files')) t(fault)")

_SH = "shards AS (SELECT source, file, count(*) AS rows, CAST(sum(n_chars) AS BIGINT) AS score FROM (SELECT source, n_chars, 'shard-' || CAST(CAST(floor(doc_id / 20) AS BIGINT) % 8 AS STR) AS file FROM {documents}) a GROUP BY source, file)"


def _shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).groupBy("source", F.concat(F.lit("shard-"), F.pmod(F.floor(F.col("doc_id") / 20), F.lit(8))).alias("file")).agg(F.count("*").alias("rows"), F.sum("n_chars").alias("score"))


_PICK = f"WITH {_SH}, picked AS (SELECT source, file, rows, score, least(rows, 25 - coalesce(sum(rows) OVER (PARTITION BY source ORDER BY score DESC, file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS taken FROM shards)"
BOOK.add("win09_shard_pick", lambda s, d: pick_shards(_shards(s, d), F.lit(25)), f"{_PICK} SELECT source, file, rows, score, CAST(taken AS BIGINT) AS taken FROM picked WHERE taken > 0")
BOOK.both("win10_corrective_plan", f"WITH {_SH}, ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, file) AS r FROM shards), first AS (SELECT * FROM ranked WHERE r <= 4), kept AS (SELECT source, file, rows FROM first WHERE r > 2), burned AS (SELECT source, sum(rows) AS need FROM first WHERE r <= 2 GROUP BY source), fresh AS (SELECT f.source, f.file, least(f.rows, b.need - coalesce(sum(f.rows) OVER (PARTITION BY f.source ORDER BY f.score DESC, f.file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS rows FROM ranked f JOIN burned b ON f.source = b.source WHERE f.r > 4) SELECT source, file, CAST(rows AS BIGINT) AS rows, 'kept' AS part FROM kept UNION ALL SELECT source, file, CAST(rows AS BIGINT), 'fresh' FROM fresh WHERE rows > 0")
BOOK.add("mix08_replay_plan", lambda s, d: pick_shards(_shards(s, d), F.lit(25)).withColumn("pass", F.explode(F.sequence(F.lit(1), F.when(F.col("source") < "src5", 3).otherwise(1)))).groupBy("pass", "source").agg(F.sum("taken").alias("trained"), F.sum(F.when(F.col("pass") == 1, F.col("taken")).otherwise(0)).alias("fresh")), f"{_PICK} SELECT CAST(pass AS INTEGER) AS pass, source, CAST(sum(taken) AS BIGINT) AS trained, CAST(sum(CASE WHEN pass = 1 THEN taken ELSE 0 END) AS BIGINT) AS fresh FROM (SELECT *, unnest(range(1, CASE WHEN source < 'src5' THEN 4 ELSE 2 END)) AS pass FROM picked WHERE taken > 0) GROUP BY 1, 2")
BOOK.both("mix09_replay_faults", f"WITH {_SH}, plan AS (SELECT source, file, rows + CASE WHEN file = 'shard-3' THEN 5 ELSE 0 END AS rows FROM shards UNION ALL SELECT 'nowhere', 'shard-0', 3), counted AS (SELECT p.source, p.file, p.rows, s.rows AS have FROM plan p LEFT JOIN shards s ON p.source = s.source AND p.file = s.file) SELECT source, file, CASE WHEN have IS NULL THEN 'unknown file' ELSE 'too many rows' END AS fault FROM counted WHERE have IS NULL OR rows > have")
BOOK.add("mix10_replay_execution", lambda s, d: (lambda docs: numbered(numbered_within(docs, ["source"], "doc_id", out="k").join(docs.groupBy("source").agg(F.count("*").cast("double").alias("n")), "source").withColumn("key", F.col("k") / F.col("n")), "key", "source"))(_docs(s, d).select("doc_id", "source")).where("position >= 40").select("doc_id", (F.col("position") + 1).alias("place")), "WITH q AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM documents), o AS (SELECT doc_id, row_number() OVER (ORDER BY k / CAST(n AS DOUBLE), source) AS place FROM q) SELECT doc_id, CAST(place AS BIGINT) AS place FROM o WHERE place > 40")
BOOK.add("mix11_parse_budget", lambda s, d: read(s, d, "nation").select("n_nationkey", parse_tokens(F.concat(F.col("n_nationkey"), F.substring(F.lit("kMbT_x"), F.pmod("n_nationkey", F.lit(6)).cast("int") + 1, 1))).alias("tokens")), "SELECT n_nationkey, CAST(CASE n_nationkey % 6 WHEN 0 THEN n_nationkey * 1e3 WHEN 1 THEN n_nationkey * 1e6 WHEN 2 THEN n_nationkey * 1e9 WHEN 3 THEN n_nationkey * 1e12 WHEN 4 THEN n_nationkey END AS BIGINT) AS tokens FROM nation")

QUERIES, ORACLES = BOOK.queries, BOOK.oracles
