"""Ordered folds, resampling, token-array edits, tool-question parsing and vector comparisons."""

from __future__ import annotations

import ast
import json
import operator
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import twin as D
from ..dual import Book
from ..functions import text as T
from .ordering import numbered
from ..twin import S, quoted

BOOK = Book()
add, both = BOOK.add, BOOK.both
read = lambda spark, sf_dir, name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- folds ---------------------------------------------------------------------------------------------------------


def ordered_fold(rows: DataFrame, key: str, order: list[str], value: str, step, out: str, start=None) -> DataFrame:
    """Adds step(previous result, value) along each key's order; rows are streamed, a key takes constant memory."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{out}` double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), None
        for pdf in batches:
            results = []
            for k, v in zip(pdf[key], pdf[value], strict=True):
                if k != now:
                    now, state = k, start
                state = step(state, v)
                results.append(state)
            yield pdf.assign(**{out: results})

    return rows.repartition(n, key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def ewma(rows: DataFrame, key: str, order: list[str], value: str, keep: float = 0.99) -> DataFrame:
    """Exponentially weighted mean; the first value is the seed."""
    return ordered_fold(rows, key, order, value, lambda s, v: v if s is None else keep * s + (1 - keep) * v, "ewma")


def reward_advantage(rows: DataFrame, key: str, order: list[str], value: str, beta: float = 0.9) -> DataFrame:
    """Baseline b = beta * b + (1 - beta) * r, and then the advantage r - b against the moved baseline."""
    out = ordered_fold(rows, key, order, value, lambda s, v: beta * (s or 0.0) + (1 - beta) * v, "baseline", 0.0)
    return out.withColumn("advantage", F.col(value) - F.col("baseline"))


def sample_indices(n: Column, k: int) -> Column:
    """k indices evenly from 0 to n - 1, halves to the even one."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (n - 1) / float(max(1, k - 1))).cast("int"))


def resample(rows: DataFrame, key: str, order: list[str], value: str, steps: int) -> DataFrame:
    """(key, step, value): each key's ordered values interpolated linearly on `steps` even places."""
    w = Window.partitionBy(key).orderBy(*order)
    n = F.count("*").over(Window.partitionBy(key))
    segment = rows.select(key, value, (F.row_number().over(w) - 1).alias("i"), F.lead(value).over(w).alias("next"), n.alias("n"))
    at = F.lit(1.0) * F.col("step") * (F.col("n") - 1) / (steps - 1)
    low = F.ceil(F.lit(steps - 1) * F.col("i") / F.greatest(F.col("n") - 1, F.lit(1)))
    high = F.when(F.col("next").isNull(), F.lit(steps - 1)).otherwise(F.ceil(F.lit(steps - 1) * (F.col("i") + 1) / F.greatest(F.col("n") - 1, F.lit(1))) - 1)
    spread = segment.withColumn("step", F.explode(F.when(low <= high, F.sequence(low.cast("int"), high.cast("int")))))
    part = at - F.col("i")
    return spread.select(key, "step", (F.col(value) + part * F.coalesce(F.col("next") - F.col(value), F.lit(0.0))).alias("value"))


# ---- token arrays --------------------------------------------------------------------------------------------------


def visible_supervised(labels: Column, length: int, ignore: int = -100) -> Column:
    """Supervised labels among the last `length` ones."""
    tail = F.slice(labels, F.greatest(F.size(labels) - length + 1, F.lit(1)), F.lit(length))
    return F.size(F.filter(tail, lambda x: x != ignore))


def valid_ids(ids: Column, length: int, vocab: int) -> Column:
    return (F.size(ids) > 0) & (F.size(ids) <= length) & (F.array_min(ids) >= 0) & (F.array_max(ids) < vocab)


def relabel(ids: Column, labels: Column, marker: list[int], eos: int, ignore: int = -100) -> Column:
    """Labels with every span after a marker, up to and with the next eos, supervised; without eos the old labels stay."""
    n = F.size(ids)

    def new(x: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.slice(x, i, F.lit(len(marker))) == F.array(*[F.lit(m) for m in marker]))
        return T.let(starts, lambda s: F.transform(x, lambda t, i: F.when(F.exists(s, lambda a: (a + len(marker) <= i + 1) & (F.coalesce(F.nullif(F.array_position(F.slice(x, a + len(marker), n), eos), F.lit(0)), F.lit(0)) > 0) & (i + 1 <= a + len(marker) - 1 + F.array_position(F.slice(x, a + len(marker), n), eos))), t).otherwise(F.get(labels, i))))

    return T.let(ids, new)


def relabelled(examples: DataFrame, marker: list[int], eos: int, ignore: int = -100) -> DataFrame:
    """examples(example_id, ids, labels) with all answers supervised again, and what that changed: content, counts and a digest.

    The ids are taken over as they are; digest is of ids and new labels, so that a copy can be held against it.
    """
    out = examples.withColumn("new", relabel(F.col("ids"), F.col("labels"), marker, eos, ignore))
    count = lambda x: F.size(F.filter(x, lambda v: v != ignore)).cast("long")
    text = F.concat_ws("|", F.array_join(F.col("ids").cast("array<string>"), " "), F.array_join(F.col("new").cast("array<string>"), " "))
    return out.select("example_id", "ids", F.col("new").alias("labels"), count(F.col("labels")).alias("was"), count(F.col("new")).alias("supervised"), F.sha2(text, 256).alias("digest"))


def reasoning_envelope(ids: Column, labels: Column, before: list[int], after: list[int], eos: int, length: int, ignore: int = -100) -> Column:
    """(ids, labels) of `length` with the last supervised span put between `before` and `after`; labels name the next token.

    The span is cut from the right and what leads to it from the left where both are too long; an example without a supervised
    token raises.  The rest is filled with eos, which isn't supervised.
    """
    array = lambda x: F.array(*[F.lit(v).cast("bigint") for v in x])
    on = lambda x: F.filter(F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1))), lambda i: F.coalesce(F.get(x, i - 1), F.lit(ignore).cast("bigint")) != ignore)

    def with_active(x: Column) -> Column:
        end = F.array_max(x)
        # the span's first place: the last active one whose neighbour before isn't active
        start = F.array_max(F.filter(x, lambda i: ~F.array_contains(x, i - 1)))
        answer = F.filter(F.slice(labels, start, end - start + 1), lambda v: (v != eos) & (v != ignore))
        room = max(1, length - len(before) - len(after) - 1)
        completion = F.concat(array(before), F.slice(answer, 1, room), array(after), array([eos]))

        def built(c: Column) -> Column:
            prompt = F.slice(ids, 1, start)
            keep = F.least(F.size(prompt), F.greatest(F.lit(1), F.lit(length + 1) - F.size(c)))
            prompt = F.slice(prompt, F.size(prompt) - keep + 1, keep)
            full = F.slice(F.concat(prompt, c), 1, length + 1)
            n = F.size(full)
            inputs, targets = F.slice(full, 1, n - 1), F.transform(F.slice(full, 2, n - 1), lambda v, i: F.when(i < keep - 1, F.lit(ignore).cast("bigint")).otherwise(v))
            pad = F.greatest(F.lit(length) - n + 1, F.lit(0))
            return F.struct(F.concat(inputs, F.array_repeat(F.lit(eos).cast("bigint"), pad)).alias("ids"), F.concat(targets, F.array_repeat(F.lit(ignore).cast("bigint"), pad)).alias("labels"))

        return F.when(F.size(x) > 0, T.let(completion, built)).otherwise(F.raise_error(F.lit("an envelope needs supervised tokens")))

    return T.let(on(labels), with_active)


def hard_negatives(rows: DataFrame, negatives: str, n: int, seed: int = 1, key: str = "id") -> DataFrame:
    """rows with n of their negatives: without replacement if there are as many, else with; rows without negatives go."""
    x = F.col(negatives)
    ranked = F.transform(F.array_sort(F.transform(x, lambda v, i: F.struct(F.xxhash64(F.lit(seed), F.col(key), i).alias("h"), v.alias("v")))), lambda p: p["v"])
    drawn = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda j: F.get(x, F.pmod(F.xxhash64(F.lit(seed), F.col(key), j), F.size(x)).cast("int")))
    return rows.where(F.size(x) > 0).withColumn(negatives, F.when(F.size(x) >= n, F.slice(ranked, 1, n)).otherwise(drawn))


def bounded_negatives(rows: DataFrame, group: str, key: str, n: int, seed: int = 1) -> DataFrame:
    """(group, key, negatives): for each row its n first others of the group by a hash, from n + 1 candidates a group.

    Candidates are the smallest hashes of a group, limited before rows are moved; no list of a whole group is made.
    """
    hashed = rows.select(group, key, F.xxhash64(F.lit(seed), F.col(key)).alias("h"))
    few = hashed.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy("h", key))).where(F.col("r") <= n + 1)
    lists = few.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("h", key))), lambda p: p[key]).alias("few"))
    # a row for each group
    return rows.select(group, key).join(lists, group).select(group, key, F.slice(F.filter("few", lambda v: v != F.col(key)), 1, n).alias("negatives"))


def ratio_quotas(ratios: DataFrame, total: int, paired: tuple[str, ...] = ()) -> DataFrame:
    """ratios(source, weight) with quota: the whole part of its share; sources that write pairs end on an even number, one over."""
    quota = F.floor(F.col("weight") / F.sum("weight").over(Window.partitionBy()) * total + 1e-9).cast("long")
    return ratios.withColumn("quota", quota).withColumn("quota", F.when(F.col("source").isin(*paired), F.col("quota") + F.col("quota") % 2).otherwise(F.col("quota")))


def packed_with_separators(rows: DataFrame, pack: str, order: str, ids: str, labels: str, separator: int, ignore: int = -100) -> DataFrame:
    """(pack, ids, labels): items in order with a separator between them, which is never supervised."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(ids).alias("i"), F.col(labels).alias("l")))), lambda x: x)
    joined = rows.groupBy(pack).agg(items.alias("x"))
    put = lambda field, mark: F.aggregate("x", F.array().cast("array<int>"), lambda acc, x: F.when(F.size(acc) == 0, x[field]).otherwise(F.concat(acc, F.array(F.lit(mark)), x[field])))
    return joined.select(pack, put("i", separator).alias("ids"), put("l", ignore).alias("labels"))


def set_f1(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """Mean F1 of token sets; a pair with an empty side adds nothing and still counts."""
    x = rows.select(F.array_distinct(T.plain_tokens(a)).alias("a"), F.array_distinct(T.plain_tokens(b)).alias("b"))
    common = F.size(F.array_intersect("a", "b"))
    f1 = F.when((F.size("a") == 0) | (F.size("b") == 0) | (common == 0), 0.0).otherwise(2.0 * common / (F.size("a") + F.size("b")))
    return x.agg(F.round(F.sum(f1) / F.count("*"), 9).alias("f1"))


def augment(ids: Column, key: Column, drop: float, seed: int = 0) -> Column:
    """Tokens left out with a probability, by a hash of key and place."""
    keep = F.filter(F.transform(ids, lambda x, i: F.struct(x.alias("x"), (F.pmod(F.xxhash64(F.lit(seed), key, i), F.lit(1000)) >= int(drop * 1000)).alias("k"))), lambda p: p["k"])
    return F.transform(keep, lambda p: p["x"])


def mixup_pairs(rows: DataFrame, key: str) -> DataFrame:
    """(key, partner): each row with the next one in hash order, the last with the first."""
    placed = numbered(rows.select(key, F.xxhash64(key).alias("_h")), "_h", key)
    following = placed.select(F.col("position").alias("_at"), F.col(key).alias("partner"))
    return placed.withColumn("_at", F.pmod(F.col("position") + 1, F.lit(max(1, rows.count())))).join(following, "_at").select(key, "partner")


# ---- tool questions ------------------------------------------------------------------------------------------------

DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"


def arithmetic_expression(x: Column) -> Column:
    """The arithmetic in a question without dates, reduced to digits and operators; null if there is none."""
    body = F.regexp_replace(T.strip(x), r"\?+$", "")
    # What introduces a question's expression.
    cue = rf"(?i)(?:what is|calculate|compute|tell me|how much is|combien fait|calcule)[{S}]+(.+)$"
    body = F.when(F.regexp_like(body, F.lit(cue)), F.regexp_extract(body, cue, 1)).otherwise(body)
    bare = F.regexp_replace(body, r"[^0-9+\-*/().%]", "")
    return F.when(~F.regexp_like(x, F.lit(DATE)) & F.regexp_like(bare, F.lit("[0-9]")) & F.regexp_like(bare, F.lit(r"[+\-*/%]")), bare)


_OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.Pow: operator.pow, ast.USub: operator.neg, ast.UAdd: operator.pos}


def calculate(expression: str) -> str | None:
    """The value of an arithmetic expression of numbers and operators, powers of 10 at most; null where it has none."""

    def value(node: ast.AST) -> float:
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return node.value
        if isinstance(node, ast.UnaryOp) and type(node.op) in _OPERATORS:
            return _OPERATORS[type(node.op)](value(node.operand))
        if isinstance(node, ast.BinOp) and type(node.op) in _OPERATORS:
            left, right = value(node.left), value(node.right)
            if isinstance(node.op, ast.Pow) and abs(right) > 10:
                raise ValueError("power")
            return _OPERATORS[type(node.op)](left, right)
        raise ValueError("not arithmetic")

    try:
        out = value(ast.parse(expression, mode="eval").body)
    except (ValueError, SyntaxError, ZeroDivisionError, OverflowError, RecursionError, MemoryError):
        return None
    if isinstance(out, complex):
        return None
    return str(int(out)) if isinstance(out, float) and out.is_integer() else str(out)


def calculator(rows: DataFrame, column: str, out: str = "result") -> DataFrame:
    """Adds the value of each row's expression; expressions of another shape than arithmetic are null."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{out}` string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{out: [calculate(x) if x else None for x in pdf[column]]})

    return rows.mapInPandas(run, schema)


def date_answer(x: Column) -> Column:
    """The answer to a question about dates: a weekday's name, a difference in days or a later date; null for others."""
    dates, low = F.regexp_extract_all(x, F.lit(f"({DATE})"), F.lit(1)), F.lower(x)
    has = lambda *words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    first, second = F.get(dates, F.lit(0)).try_cast("date"), F.get(dates, F.lit(1)).try_cast("date")
    number = F.regexp_extract(F.regexp_replace(x, DATE, ""), r"([+-]?[0-9]+)", 1).try_cast("int")
    # The words that tell the kinds of date questions.
    return (
        F.when(has("day of the week", "weekday", "jour de la semaine"), F.date_format(first, "EEEE"))
        .when((F.size(dates) >= 2) & has("between", "difference", "from ", "entre", "différence"), F.date_diff(second, first).cast("string"))
        .when(has("plus", "add", "after", "après") & has("day"), F.date_add(first, number).cast("string"))
    )


# ---- monitored feedback --------------------------------------------------------------------------------------------

# Words of a negative and of a positive answer; negative ones win.
NEGATIVE, POSITIVE = ("wrong", "false", "bad", "non", "faux", "incorrect"), ("correct", "good", "yes", "oui", "exact")


def feedback_reward(feedback: Column, entropy: Column, confidence: Column, high: float = 2.5, low: float = 0.35) -> Column:
    said = F.lower(F.coalesce(feedback, F.lit("")))
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(said, w))
    unsure = F.coalesce(entropy >= high, F.lit(False)) | F.coalesce(confidence <= low, F.lit(False))
    return F.when(has(NEGATIVE), -1.0).when(has(POSITIVE), 1.0).when(unsure, -0.1).otherwise(0.0)


def monitored(feedback: Column, entropy: Column, confidence: Column, high: float = 2.5, low: float = 0.35) -> Column:
    return (T.strip(F.coalesce(feedback, F.lit(""))) != "") | F.coalesce(entropy >= high, F.lit(False)) | F.coalesce(confidence <= low, F.lit(False))


# ---- vectors -------------------------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def class_cosines(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """(a, b, cosine) of the mean vectors of classes; only one row per class meets another."""
    means = vectors.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    norms = means.groupBy(label).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    pairs = means.alias("p").join(means.alias("q"), F.expr(f"p.i = q.i and p.{label} <= q.{label}")).groupBy(F.col(f"p.{label}").alias("a"), F.col(f"q.{label}").alias("b")).agg(F.sum(F.col("p.m") * F.col("q.m")).alias("dot"))
    out = pairs.join(norms.select(F.col(label).alias("a"), F.col("norm").alias("na")), "a").join(norms.select(F.col(label).alias("b"), F.col("norm").alias("nb")), "b")
    return out.select("a", "b", F.round(F.col("dot") / (F.col("na") * F.col("nb")), 6).alias("cosine"))


def linear_cka(left: DataFrame, right: DataFrame, key: str, vector: str) -> DataFrame:
    """Similarity of two sets of activations of the same rows: centred cross-products in dimension space, 0 without spread."""

    def centred(df: DataFrame) -> DataFrame:
        rows = df.select(key, F.posexplode(vector).alias("i", "x"))
        return rows.join(F.broadcast(rows.groupBy("i").agg(F.avg("x").alias("m"))), "i").select(key, "i", (F.col("x") - F.col("m")).alias("x"))

    def norm(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        cross = a.alias("a").join(b.alias("b"), F.expr(f"a.{key} = b.{key}")).groupBy(F.col("a.i").alias("i"), F.col("b.i").alias("j")).agg(F.sum(F.col("a.x") * F.col("b.x")).alias("c"))
        return cross.agg(F.sum(F.col("c") * F.col("c")).alias(name))

    x, y = centred(left), centred(right)
    parts = norm(x, y, "xy").crossJoin(norm(x, x, "xx")).crossJoin(norm(y, y, "yy"))
    return parts.select(F.when(F.col("xx") * F.col("yy") > 0, F.round(F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")), 6)).otherwise(0.0).alias("cka"))


# ---- byte pairs ----------------------------------------------------------------------------------------------------


def train_byte_pairs(counts: DataFrame, merges: int) -> list[tuple[str, str]]:
    """Merges of the most frequent adjacent pair, ties to the smaller one; counts: (token, cnt), one row per word.

    Each merge is one aggregation over the table of distinct words; only the winning pair reaches the driver.
    """
    words = counts.select(F.split("token", "").alias("s"), "cnt").where(F.size("s") > 1)
    out: list[tuple[str, str]] = []
    for _ in range(merges):
        pairs = words.select("cnt", F.explode(F.zip_with(F.slice("s", F.lit(1), F.size("s") - 1), F.slice("s", F.lit(2), F.size("s")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p"))
        best = pairs.where("p.b is not null").groupBy("p").agg(F.sum("cnt").alias("n")).orderBy(F.desc("n"), "p").first()
        if best is None or best.n < 2:
            break
        out.append((best.p.a, best.p.b))
        words = words.select(merge_pair(F.col("s"), *out[-1]).alias("s"), "cnt").where(F.size("s") > 1)
    return out


def merge_pair(symbols: Column, a: str, b: str) -> Column:
    """Adjacent a, b become ab, from the left."""
    none = F.array().cast("array<string>")
    return F.aggregate(symbols, none, lambda acc, x: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) == a) & (x == b), F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.lit(a + b)))).otherwise(F.concat(acc, F.array(x))))


def byte_letters() -> list[str]:
    """A letter for each byte, as byte-level vocabularies spell them: printable ones stand for themselves, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(0x100 + rest.index(b)) for b in range(256)]


def merges_of_file(path: str) -> list[tuple[str, str]]:
    """The merges of a byte-pair vocabulary in the JSON form of the tokenizers library, best rank first."""
    with open(path, encoding="utf-8") as file:
        merges = json.load(file)["model"]["merges"]
    return [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in merges]


#: Words whose pieces a task keeps; beyond them it starts anew.
REMEMBERED = 100_000


def encode_byte_pairs(word: Column, merges: list[tuple[str, str]], end: str = "", byte_level: bool = False) -> Column:
    """The pieces of a word: of all adjacent pairs the one of the best rank is merged wherever it stands, until none has a rank.

    end is put to the last symbol; byte_level spells the word in byte letters first.  The ranks go with the task, so their
    size is that of the vocabulary.  A null has null pieces, an empty word none.
    """
    ranks = {pair: i for i, pair in reversed(list(enumerate(merges)))}
    letters = byte_letters()

    def pieces(w: str) -> list[str]:
        s = [letters[b] for b in w.encode()] if byte_level else list(w)
        if s:
            s[-1] += end
        while len(s) > 1:
            best = min(zip(s, s[1:], strict=False), key=lambda p: ranks.get(p, len(ranks)))
            if best not in ranks:
                break
            out, i = [], 0
            while i < len(s):
                pair = i + 1 < len(s) and (s[i], s[i + 1]) == best
                out.append(s[i] + s[i + 1] if pair else s[i])
                i += 2 if pair else 1
            s = out
        return s

    @F.pandas_udf("array<string>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, list[str]] = {}
        for words in batches:
            if len(known) > REMEMBERED:
                known.clear()
            for w in words.dropna().unique():
                if w not in known:
                    known[w] = pieces(w)
            yield words.map(known.get, na_action="ignore")

    return encoded(word)


# ---- queries -------------------------------------------------------------------------------------------------------

_events = lambda s, d: read(s, d, "events").select("user_id", "event_id", "ts", "value")
add("win17_ewma", lambda s, d: ewma(_events(s, d), "user_id", ["ts", "event_id"], "value", 0.9).select("user_id", "event_id", F.round("ewma", 6).alias("ewma")), "WITH RECURSIVE o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events), f AS (SELECT user_id, event_id, r, value AS e FROM o WHERE r = 1 UNION ALL SELECT o.user_id, o.event_id, o.r, 0.9::DOUBLE * f.e + (1 - 0.9::DOUBLE) * o.value FROM f JOIN o ON o.user_id = f.user_id AND o.r = f.r + 1) SELECT user_id, event_id, round(e, 6) AS ewma FROM f")
add("stm09_reward_baseline", lambda s, d: reward_advantage(_events(s, d), "user_id", ["ts", "event_id"], "value").select("user_id", "event_id", F.round("advantage", 6).alias("advantage")), "WITH RECURSIVE o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events), f AS (SELECT user_id, event_id, r, value, (1 - 0.9::DOUBLE) * value AS b FROM o WHERE r = 1 UNION ALL SELECT o.user_id, o.event_id, o.r, o.value, 0.9::DOUBLE * f.b + (1 - 0.9::DOUBLE) * o.value FROM f JOIN o ON o.user_id = f.user_id AND o.r = f.r + 1) SELECT user_id, event_id, round(value - b, 6) AS advantage FROM f")
add("win23_sample_indices", lambda s, d: read(s, d, "part").select("p_partkey", F.array_join(sample_indices(F.col("p_size"), 5), " ").alias("at")), "SELECT p_partkey, array_to_string([CAST(round_even(i * (p_size - 1) / 4.0::DOUBLE, 0) AS INTEGER) FOR i IN range(0, 5)], ' ') AS at FROM part")
add("win24_resample", lambda s, d: resample(_events(s, d), "user_id", ["ts", "event_id"], "value", 9).select("user_id", "step", F.round("value", 5).alias("value")), "WITH o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events), g AS (SELECT DISTINCT user_id, n, CAST(step AS INTEGER) AS step, step * (n - 1) / 8.0::DOUBLE AS pos FROM o, range(9) r(step)) SELECT g.user_id, step, round(a.value + (pos - floor(pos)) * coalesce(b.value - a.value, 0), 5) AS value FROM g JOIN o a ON a.user_id = g.user_id AND a.i = floor(pos) LEFT JOIN o b ON b.user_id = g.user_id AND b.i = floor(pos) + 1")
both("win26_frame_features", "SELECT l_orderkey AS frame, round(ln(1 + count(*)), 9) AS log_count, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS sd, max(l_quantity) AS top FROM {lineitem} GROUP BY l_orderkey")
both("win27_scaled_clip", "SELECT event_id, user_id % 5 AS device, least(4e0, greatest(-4e0, value / 25e0)) AS scaled FROM {events}")
both("win25_root_relative", "SELECT l_orderkey, l_linenumber, round((l_quantity - first_value(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity)) / m, 6) AS rel FROM (SELECT *, median(l_extendedprice) OVER (PARTITION BY l_orderkey) AS m FROM {lineitem}) x")
both("win28_fusion_sweep", "SELECT w, round(avg(CASE WHEN w * l_discount + (1 - w) * l_tax > 0.05e0 THEN 1e0 ELSE 0e0 END), 9) AS top1 FROM {lineitem} CROSS JOIN (SELECT r_regionkey / 4e0 AS w FROM {region}) g GROUP BY w")
add("agg07_visible_supervised", lambda s, d: read(s, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.when(F.pmod("l_partkey", F.lit(3)) == 0, -100).otherwise(F.col("l_linenumber")).alias("x")))), lambda p: p["x"]).alias("labels")).select("l_orderkey", visible_supervised(F.col("labels"), 4).cast("long").alias("n")), "SELECT l_orderkey, count(*) FILTER (back <= 4 AND l_partkey % 3 <> 0) AS n FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, CASE WHEN l_partkey % 3 = 0 THEN -100 ELSE l_linenumber END DESC) AS back FROM lineitem) GROUP BY l_orderkey")
add("agg26_set_f1", lambda s, d: (lambda c: set_f1(c.alias("a").join(c.alias("b"), F.expr("a.conv_id = b.conv_id and b.turn = a.turn + 1")), F.col("a.text"), F.col("b.text")))(read(s, d, "conversations")), f"SELECT round(sum(CASE WHEN len(x) = 0 OR len(y) = 0 OR len(list_intersect(x, y)) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(x, y)) / (len(x) + len(y)) END) / count(*), 9) AS f1 FROM (SELECT list_distinct({D.plain_tokens('a.text')}) AS x, list_distinct({D.plain_tokens('b.text')}) AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)")
add("flt09_valid_ids", lambda s, d: read(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_suppkey").cast("int")).alias("ids")).select("l_orderkey", valid_ids(F.col("ids"), 5, 90).alias("ok")), "SELECT l_orderkey, count(*) <= 5 AND min(l_suppkey) >= 0 AND max(l_suppkey) < 90 AS ok FROM lineitem GROUP BY l_orderkey")
add("flt10_sanitize_config", lambda s, d: read(s, d, "nation").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("n_name", F.col("n_regionkey").cast("string").alias("v"))))).alias("m")).select(F.explode(F.map_filter("m", lambda k, v: ~F.exists(F.array(F.lit("UNITED"), F.lit("CHINA")), lambda b: F.contains(k, b)))).alias("k", "v")), "SELECT n_name AS k, CAST(n_regionkey AS VARCHAR) AS v FROM nation WHERE NOT (contains(n_name, 'UNITED') OR contains(n_name, 'CHINA'))")
add("map01_merge", lambda s, d: read(s, d, "nation").select("n_nationkey", F.explode(F.map_concat(F.map_filter(F.create_map(F.lit("a"), F.lit(0), F.lit("b"), F.col("n_regionkey")), lambda k, v: k != "a"), F.create_map(F.lit("a"), F.col("n_nationkey")))).alias("k", "v")), "SELECT n_nationkey, 'a' AS k, n_nationkey AS v FROM nation UNION ALL SELECT n_nationkey, 'b', n_regionkey FROM nation")
add("pck07_separators", lambda s, d: packed_with_separators(read(s, d, "lineitem").select((F.floor(F.col("l_orderkey") / 8)).alias("pack"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"), F.array(F.col("l_linenumber")).alias("i"), F.array(F.lit(7)).alias("l")), "pack", "o", "i", "l", -1).select("pack", F.array_join("ids", " ").alias("ids"), F.array_join("labels", " ").alias("labels")), "SELECT l_orderkey // 8 AS pack, string_agg(CAST(l_linenumber AS VARCHAR), ' -1 ' ORDER BY l_orderkey * 10 + l_linenumber) AS ids, string_agg('7', ' -100 ') AS labels FROM lineitem GROUP BY 1")
add("pck11_relabel", lambda s, d: read(s, d, "part").select("p_partkey", F.array(*[F.lit(x) for x in (5, 9, 1, 2, 0)], F.col("p_size"), *[F.lit(x) for x in (9, 1, 4, 0, 9, 1, 8)]).alias("ids")).select("p_partkey", F.array_join(relabel(F.col("ids"), F.transform("ids", lambda _: F.lit(-100)), [9, 1], 0), " ").alias("labels")), "SELECT p_partkey, '-100 -100 -100 2 0 -100 -100 -100 4 0 -100 -100 -100' AS labels FROM part")
add("str09_arithmetic", lambda s, d: read(s, d, "part").select("p_partkey", arithmetic_expression(F.concat(F.lit("What is "), F.col("p_size"), F.when(F.pmod("p_partkey", F.lit(2)) == 0, " + 2 * (3)?").otherwise(" apples?"))).alias("e")), "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) || '+2*(3)' END AS e FROM part")
add("str10_calculator", lambda s, d: calculator(read(s, d, "part").select("p_partkey", F.concat(F.col("p_size"), F.lit("+2*(3)")).alias("e")), "e").select("p_partkey", "result"), "SELECT p_partkey, CAST(p_size + 6 AS VARCHAR) AS result FROM part")
add("dat02_date_intent", lambda s, d: read(s, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("x")).select("o_orderkey", date_answer(F.when(F.pmod("o_orderkey", F.lit(3)) == 0, F.concat(F.lit("What weekday is "), F.col("x"))).when(F.pmod("o_orderkey", F.lit(3)) == 1, F.concat(F.lit("days between "), F.col("x"), F.lit(" and 2000-01-01"))).otherwise(F.concat(F.col("x"), F.lit(" plus 12 days")))).alias("answer")), "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN dayname(o_orderdate) WHEN 1 THEN CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS VARCHAR) ELSE CAST(CAST(CAST(o_orderdate AS DATE) + 12 AS DATE) AS VARCHAR) END AS answer FROM orders")
add("dat03_tool_episode", lambda s, d: calculator(read(s, d, "part").select("p_partkey", arithmetic_expression(F.concat(F.lit("calculate "), F.col("p_size"), F.lit("*2"))).alias("e"), date_answer(F.lit("no date")).alias("dt")), "e", "calc").select("p_partkey", F.coalesce("dt", "calc").alias("result")), "SELECT p_partkey, CAST(p_size * 2 AS VARCHAR) AS result FROM part")
add("stm02_trigger", lambda s, d: read(s, d, "events").where(monitored(F.when(F.col("event_type") == "signup", F.lit(" ok ")), F.col("value") / 40, F.col("value") / 100)).select("event_id"), "SELECT event_id FROM events WHERE event_type = 'signup' OR value / 40 >= 2.5 OR value / 100 <= 0.35::DOUBLE")
add("stm03_feedback_reward", lambda s, d: read(s, d, "events").select("event_id", feedback_reward(F.when(F.col("event_type") == "click", F.lit("Incorrect!")).when(F.col("event_type") == "view", F.lit("oui")), F.col("value") / 40, F.lit(None).cast("double")).alias("reward")), "SELECT event_id, CASE event_type WHEN 'click' THEN -1.0::DOUBLE WHEN 'view' THEN 1.0::DOUBLE ELSE CASE WHEN value / 40 >= 2.5 THEN -0.1::DOUBLE ELSE 0.0::DOUBLE END END AS reward FROM events")
add("stm06_resume_cursor", lambda s, d: numbered(read(s, d, "events").select("event_id"), "event_id").where("position >= 500").select("event_id", F.floor(F.col("position") / 32).alias("batch")), "SELECT event_id, CAST(floor((r - 1) / 32) AS BIGINT) AS batch FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS r FROM events) x WHERE r > 500")
both("stm10_stalls", "SELECT user_id, max(ts) AS last_seen FROM {events} GROUP BY user_id HAVING max(ts) < (SELECT max(ts) FROM {events}) - INTERVAL 1 DAY")
add("agg31_class_cosines", lambda s, d: class_cosines(read(s, d, "embeddings")), "WITH m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY label) SELECT a, b, round(d / (x.n * y.n), 6) AS cosine FROM (SELECT p.label AS a, q.label AS b, sum(p.m * q.m) AS d FROM m p JOIN m q ON p.i = q.i AND p.label <= q.label GROUP BY 1, 2) JOIN n x ON x.label = a JOIN n y ON y.label = b")
add("agg30_linear_cka", lambda s, d: linear_cka(read(s, d, "embeddings").select("vec_id", F.slice("embedding", 1, 16).alias("v")), read(s, d, "embeddings").select("vec_id", F.slice("embedding", 9, 16).alias("v")), "vec_id", "v"))
add("met09_vector_similarity", lambda s, d: (lambda v: v.alias("a").join(v.alias("b"), F.expr("b.vec_id = a.vec_id + 1")).select(F.col("a.vec_id").alias("vec_id"), F.round(dot(F.col("a.embedding"), F.col("b.embedding")) / F.sqrt(dot(F.col("a.embedding"), F.col("a.embedding")) * dot(F.col("b.embedding"), F.col("b.embedding"))), 5).alias("f1")))(read(s, d, "embeddings")), "SELECT a.vec_id, round(sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x)), 5) AS f1 FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) a JOIN (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) b ON b.vec_id = a.vec_id + 1 AND a.i = b.i GROUP BY a.vec_id")
add("arr04_token_drop", lambda s, d: read(s, d, "benchmark").select("item_id", F.size(augment(T.plain_tokens(F.col("text")), F.col("item_id"), 0.2)).alias("n")))
add("arr05_mixup_pairs", lambda s, d: mixup_pairs(read(s, d, "benchmark"), "item_id"))
#: The public vocabulary whose merges tok03 encodes with.
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"


def byte_pair_pieces(texts: DataFrame, key: str, merges: list[tuple[str, str]], end: str = "</w>") -> DataFrame:
    """(key, w, pieces): a row for each word of each text, its pieces in byte letters with blanks between."""
    words = texts.select(key, F.explode(T.plain_tokens(F.col("text"))).alias("w"))
    return words.select(key, "w", F.array_join(encode_byte_pairs(F.col("w"), merges, end, True), " ").alias("pieces"))


add("tok03_byte_pair_encode", lambda s, d: byte_pair_pieces(read(s, d, "benchmark"), "item_id", merges_of_file(VOCABULARY)))
add("tok04_train_byte_pairs", lambda s, d: s.createDataFrame([(i, a, b) for i, (a, b) in enumerate(train_byte_pairs(read(s, d, "benchmark").select(F.explode(T.plain_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("cnt")), 5))], "rank int, a string, b string"))
both("tok05_format_specials", "SELECT r_regionkey, CASE r_regionkey WHEN 0 THEN '<|begin|>' WHEN 1 THEN '<|begin_of_text|>' WHEN 2 THEN '<s>' WHEN 3 THEN '<|im_start|>' ELSE '<bos>' END AS bos FROM {region}")
both("tok07_format_by_name", "SELECT p_partkey, CASE WHEN lower(p_name) LIKE '%red%' THEN 'llama3' WHEN lower(p_name) LIKE '%blue%' THEN 'mistral' ELSE 'native' END AS style FROM {part}")

QUERIES, ORACLES = BOOK.queries, BOOK.oracles
