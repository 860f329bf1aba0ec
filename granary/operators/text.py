"""Text filters, extraction, text-quality and generation metrics over the document and conversation tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import twin as D
from ..functions import text as T
from ..twin import S, W, quoted

documents, conversations, pages, benchmark = map(D.read, ("documents", "conversations", "pages", "benchmark"))


# ---- operators -----------------------------------------------------------------------------------------------------


def clean_text(df: DataFrame, column: str = "text", **options: object) -> DataFrame:
    """The cleaner as a stage: rows whose cleaned text is missing or too short go."""
    return df.withColumn(column, T.clean(F.col(column), **options)).where(F.col(column).isNotNull())


def pipeline(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Steps in order; each sees only what the one before kept."""
    for step in steps:
        df = df.transform(step)
    return df


def keep_instruction(prompt: Column, completion: Column, low: int = 3, high: int = 4000) -> Column:
    """Both sides between low and high characters, without pictures or links."""
    both = F.lower(F.concat(prompt, F.lit("\n"), completion))
    sized = lambda x: (F.length(x) >= low) & (F.length(x) <= high)
    return sized(prompt) & sized(completion) & ~F.exists(F.array(*map(F.lit, ("<image", "![", "http://", "https://"))), lambda b: F.contains(both, b))


def turn_pairs(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, reference, candidate): each user turn and the assistant turn right after it."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    out = rows.withColumns({"next_role": F.lead("role").over(order), "candidate": F.lead("text").over(order)})
    return out.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("reference"), "candidate")


def clipped_overlap(pairs: DataFrame, n: int, tokens: Callable[[Column], Column] = T.metric_tokens) -> DataFrame:
    """Per pair (conv_id, turn): n-grams of both sides and their intersection with multiplicity.

    Both sides are exploded into one table and counted in one aggregation, so that a pair's grams are never joined.
    """
    def side(which: str) -> DataFrame:
        return pairs.select("conv_id", "turn", F.explode_outer(T.ngrams(tokens(F.col(which)), n)).alias("gram"), F.lit(int(which == "candidate")).alias("c"), F.lit(int(which == "reference")).alias("r"))

    counts = side("candidate").unionByName(side("reference")).groupBy("conv_id", "turn", "gram").agg(F.sum(F.when(F.col("gram").isNotNull(), F.col("c"))).alias("nc"), F.sum(F.when(F.col("gram").isNotNull(), F.col("r"))).alias("nr"))
    return counts.groupBy("conv_id", "turn").agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(a) for a, x in (("n_candidate", F.col("nc")), ("n_reference", F.col("nr")), ("n_common", F.least("nc", "nr")))])


def rouge_n(pairs: DataFrame, n: int) -> DataFrame:
    """Mean precision, recall and F1 of n-gram overlap over all pairs."""
    c = clipped_overlap(pairs, n)
    precision = F.when(F.col("n_candidate") > 0, F.col("n_common") / F.col("n_candidate")).otherwise(0.0)
    recall = F.when(F.col("n_reference") > 0, F.col("n_common") / F.col("n_reference")).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return c.agg(F.count("*").alias("pairs"), *[F.round(F.avg(x), 6).alias(a) for a, x in (("precision", precision), ("recall", recall), ("f1", f1))])


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays, by a fold that carries one row of the table."""
    row = F.array_repeat(F.lit(0), F.size(b) + 1)

    def step(previous: Column, x: Column) -> Column:
        cells = F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.size(b), F.lit(1))),
            F.array(F.lit(0)),
            lambda now, j: F.when(F.size(b) == 0, now).otherwise(F.concat(now, F.array(F.when(F.get(b, j - 1) == x, F.get(previous, j - 1) + 1).otherwise(F.greatest(F.get(previous, j), F.get(now, j - 1)))))),
        )
        return cells

    return F.get(F.aggregate(a, row, step), F.size(b))


def rouge_l(pairs: DataFrame) -> DataFrame:
    """Per pair: length of the longest common subsequence of the token arrays, and its F1 (a Python fold over Arrow batches)."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for a, b in zip(pdf["a"], pdf["b"], strict=True):
                row = [0] * (len(b) + 1)
                for x in a:
                    diagonal = 0
                    for j, y in enumerate(b, 1):
                        diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
                out.append(row[-1])
            yield pd.DataFrame({"conv_id": pdf["conv_id"], "turn": pdf["turn"], "lcs": out, "n_candidate": pdf["a"].map(len), "n_reference": pdf["b"].map(len)})

    rows = pairs.select("conv_id", "turn", T.metric_tokens(F.col("candidate")).alias("a"), T.metric_tokens(F.col("reference")).alias("b"))
    out = rows.mapInPandas(run, "conv_id long, turn long, lcs long, n_candidate long, n_reference long")
    p, r = F.col("lcs") / F.greatest("n_candidate", F.lit(1)), F.col("lcs") / F.greatest("n_reference", F.lit(1))
    return out.withColumn("f1", F.when(p + r > 0, F.round(2 * p * r / (p + r), 6)).otherwise(0.0))


def bleu_parts(pairs: DataFrame, orders: int = 4) -> DataFrame:
    """(conv_id, turn, n, common, total, len_candidate, len_reference) for each order."""
    sizes = pairs.select("conv_id", "turn", F.size(T.metric_tokens(F.col("candidate"))).cast("long").alias("len_candidate"), F.size(T.metric_tokens(F.col("reference"))).cast("long").alias("len_reference"))
    parts = None
    for n in range(1, orders + 1):
        one = clipped_overlap(pairs, n).select("conv_id", "turn", F.lit(n).alias("n"), F.col("n_common").alias("common"), F.col("n_candidate").alias("total"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.join(sizes, ["conv_id", "turn"])


def _bleu(common: str, total: str, candidate: str, reference: str) -> str:
    return f"case when max({candidate}) = 0 or min({common}) = 0 or min({total}) = 0 then 0.0 else exp(avg(ln({common} / {total}))) * least(1.0, exp(1 - max({reference}) / max({candidate}))) end"


def corpus_bleu(pairs: DataFrame) -> DataFrame:
    """Clipped and total n-grams summed over all pairs, without smoothing, times the brevity penalty."""
    parts = bleu_parts(pairs).groupBy("n").agg(*[F.sum(c).alias(c) for c in ("common", "total", "len_candidate", "len_reference")])
    return parts.agg(F.round(F.expr(_bleu("common", "total", "len_candidate", "len_reference")), 6).alias("bleu"))


def sentence_bleu(pairs: DataFrame) -> DataFrame:
    """BLEU of each pair; an order without any n-gram counts as 1 / (length + 1), an order without a match makes it 0."""
    parts = bleu_parts(pairs)
    p = F.when(F.col("total") == 0, 1.0 / (F.col("len_candidate") + 1)).otherwise(F.col("common") / F.greatest(F.col("total"), F.lit(1)))
    scored = parts.withColumn("p", p).groupBy("conv_id", "turn").agg(F.min("p").alias("low"), F.avg(F.when(F.col("p") > 0, F.log("p"))).alias("mean"), F.max("len_candidate").alias("c"), F.max("len_reference").alias("r"))
    score = F.when((F.col("c") == 0) | (F.col("low") <= 0), 0.0).otherwise(F.exp("mean") * F.least(F.lit(1.0), F.exp(1 - F.col("r") / F.greatest("c", F.lit(1)))))
    return scored.select("conv_id", "turn", F.round(score, 6).alias("bleu"))


def self_bleu(texts: DataFrame, group: str, key: str, text: str) -> DataFrame:
    """Mean BLEU-2 of each text against all others of its (small) group: n-gram maxima instead of pairs of texts.

    Clipping by the largest count among the others needs, per gram, only the two largest counts of the group.
    """
    out = None
    rows = texts.select(group, key, T.plain_tokens(F.col(text)).alias("t")).where(F.size("t") > 0)
    for n in (1, 2):
        grams = rows.select(group, key, F.explode(T.ngrams(F.col("t"), n)).alias("gram")).groupBy(group, "gram", key).agg(F.count("*").alias("k"))
        w = Window.partitionBy(group, "gram")
        top = grams.withColumns({"most": F.max("k").over(w), "holders": F.count("*").over(w), "rank": F.row_number().over(w.orderBy(F.desc("k"), key))})
        second = F.max(F.when(F.col("rank") == 2, F.col("k"))).over(w)
        other = top.withColumn("other", F.when(F.col("rank") > 1, F.col("most")).otherwise(F.coalesce(second, F.lit(0))))
        one = other.groupBy(group, key).agg(F.sum(F.least("k", "other")).alias("common"), F.sum("k").alias("total")).withColumn("n", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(group, "n").agg(F.sum("common").alias("common"), F.sum("total").alias("total"), F.count("*").alias("texts"))


def distinct_n(texts: DataFrame, orders: int = 4, text: str = "text") -> DataFrame:
    """Different n-grams over all n-grams of the whole table, for each order."""
    rows = texts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("n"), T.ngrams(T.plain_tokens(F.col(text)), n).alias("grams")) for n in range(1, orders + 1)])).alias("x"))
    grams = rows.select("x.n", F.explode("x.grams").alias("gram")).groupBy("n", "gram").count()
    return grams.groupBy("n").agg(F.count("*").alias("distinct_grams"), F.sum("count").alias("grams"), F.round(F.count("*") / F.sum("count"), 9).alias("ratio"))


def gram_entropy(texts: DataFrame, n: int, text: str = "text") -> DataFrame:
    """Entropy in bits of the n-gram distribution of the whole table, from counts of counts."""
    grams = texts.select(F.explode(T.ngrams(T.plain_tokens(F.col(text)), n)).alias("gram")).groupBy("gram").count()
    folded = grams.groupBy("count").agg(F.count("*").alias("m"))
    total = F.sum(F.col("count") * F.col("m"))
    return folded.agg(total.alias("total"), F.round(F.log2(total.cast("double")) - F.sum(F.col("m") * F.col("count") * F.log2(F.col("count").cast("double"))) / total, 6).alias("entropy"))


def response_checks(df: DataFrame, response: str, all_of: list[str], any_of: list[str], numbers: list[str], max_words: int, bullets: int, words_per_bullet: int) -> DataFrame:
    """Adds failures, an array of what a response misses; an empty response fails as such."""
    x, low = F.col(response), F.lower(F.col(response))
    lines = F.filter(F.split(x, "\n"), lambda s: F.regexp_like(s, F.lit(rf"^[{S}]*[-*][{S}]+[^{S}]")))
    counted = F.size(F.regexp_extract_all(x, F.lit(rf"([{W}']+)"), F.lit(1)))
    too_long = F.exists(lines, lambda s: F.size(F.regexp_extract_all(F.regexp_replace(s, rf"^[{S}]*[-*][{S}]+", ""), F.lit(rf"([{W}']+)"), F.lit(1))) > words_per_bullet)
    checks = [
        F.when(~F.forall(F.array(*map(F.lit, all_of)), lambda w: F.contains(low, F.lower(w))), "missing_all"),
        F.when(~F.exists(F.array(*map(F.lit, any_of)), lambda w: F.contains(low, F.lower(w))), "missing_any"),
        *[F.when(~F.regexp_like(x, F.lit(rf"(?<!\d){n}(?!\d)")), f"missing_number:{n}") for n in numbers],
        F.when(counted > max_words, F.concat(F.lit("too_many_words:"), counted)),
        F.when(F.size(lines) != bullets, F.concat(F.lit("bullet_count:"), F.size(lines))),
        F.when(too_long, "long_bullets"),
    ]
    failed = F.array_compact(F.array(*checks))
    return df.withColumn("failures", F.when(T.strip(x) == "", F.array(F.lit("empty_response"))).otherwise(failed))


# ---- queries and their twins ---------------------------------------------------------------------------------------

PAIRS = "WITH o AS (SELECT conv_id, turn, role, text AS reference, lead(role) OVER w AS next_role, lead(text) OVER w AS candidate FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), pairs AS (SELECT conv_id, turn, reference, candidate FROM o WHERE role = 'user' AND next_role = 'assistant')"


def _overlap_sql(n: int) -> str:
    one = lambda x: f"SELECT conv_id, turn, unnest(CASE WHEN len({x}t) >= {n} THEN {D.ngrams(x + 't', n)} ELSE [NULL] END) AS gram"
    return f"""tok AS (SELECT conv_id, turn, {D.metric_tokens('candidate')} AS ct, {D.metric_tokens('reference')} AS rt FROM pairs),
    g{n} AS (SELECT conv_id, turn, gram, sum(c) AS nc, sum(r) AS nr FROM (SELECT *, 1 AS c, 0 AS r FROM ({one('c')} FROM tok) UNION ALL SELECT *, 0, 1 FROM ({one('r')} FROM tok)) GROUP BY ALL),
    c{n} AS (SELECT conv_id, turn, CAST(coalesce(sum(nc) FILTER (gram IS NOT NULL), 0) AS BIGINT) AS n_candidate, CAST(coalesce(sum(nr) FILTER (gram IS NOT NULL), 0) AS BIGINT) AS n_reference, CAST(coalesce(sum(least(nc, nr)) FILTER (gram IS NOT NULL), 0) AS BIGINT) AS n_common FROM g{n} GROUP BY ALL)"""


def _rouge_sql(n: int) -> str:
    p, r = "(CASE WHEN n_candidate > 0 THEN n_common / n_candidate ELSE 0.0::DOUBLE END)", "(CASE WHEN n_reference > 0 THEN n_common / n_reference ELSE 0.0::DOUBLE END)"
    return f"{PAIRS}, {_overlap_sql(n)} SELECT count(*) AS pairs, round(avg({p}), 6) AS precision, round(avg({r}), 6) AS recall, round(avg(CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0::DOUBLE END), 6) AS f1 FROM c{n}"


def _orders_sql() -> str:
    steps = [_overlap_sql(n).replace("tok AS (", f"tok{n} AS (").replace("FROM tok)", f"FROM tok{n})") for n in range(1, 5)]
    union = " UNION ALL ".join(f"SELECT conv_id, turn, {n} AS n, n_common AS common, n_candidate AS total FROM c{n}" for n in range(1, 5))
    return f"{PAIRS}, {', '.join(steps)}, sizes AS (SELECT conv_id, turn, len({D.metric_tokens('candidate')}) AS len_candidate, len({D.metric_tokens('reference')}) AS len_reference FROM pairs), parts AS (SELECT * FROM ({union}) JOIN sizes USING (conv_id, turn))"


def _each(f: Callable[[DataFrame], DataFrame], table: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(table(spark, sf_dir))


def _pairs(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(turn_pairs(conversations(spark, sf_dir)))


CHECKS = {"all_of": ["the", "ing"], "any_of": ["tion", "eau"], "numbers": ["42", "7"], "max_words": 60, "bullets": 0, "words_per_bullet": 8}
_WORDS = f"regexp_extract_all(text, {quoted(rf'([{W}' + chr(39) + ']+)')}, 1)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "flt03_clean_text": _each(lambda d: clean_text(d, min_length=10).select("doc_id", F.col("text").alias("cleaned")), documents),
    "str08_strip_pages": _each(lambda d: d.select("page_id", T.clean(F.col("html"), 1).alias("cleaned")), pages),
    "flt04_pipeline": _each(lambda d: pipeline(d, clean_text, lambda x: x.where(F.size(T.split_words(F.col("text"))) >= 20), lambda x: x.where("source <> 'src0'")).groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars")), documents),
    "flt05_instruction_keep": _pairs(lambda p: p.select("conv_id", "turn", keep_instruction(F.col("reference"), F.col("candidate"), 3, 900).alias("keep"))),
    "flt06_emit_guard": _pairs(lambda p: p.where((F.length(T.as_text(F.col("reference"))) >= 3) & (F.length(T.as_text(F.col("candidate"))) >= 2)).select("conv_id", "turn")),
    "flt08_must_contain": _each(lambda d: d.where(F.contains(F.col("text"), F.lit("@"))).select("doc_id"), documents),
    "str01_metric_tokens": _each(lambda d: d.select("doc_id", T.metric_tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.array_join("t", " ").alias("joined")), documents),
    "str02_plain_tokens": _each(lambda d: d.select("doc_id", F.size(T.plain_tokens(F.col("text"))).cast("long").alias("n")), documents),
    "str03_opening_key": _each(lambda d: d.groupBy(T.opening_key(F.col("text"), 2).alias("opening")).agg(F.count("*").alias("docs")), documents),
    "str04_choice_answer": _each(lambda d: d.select("doc_id", T.choice_answer(F.concat(F.lit("x "), F.when(F.pmod("doc_id", F.lit(5)) == 0, F.concat(F.lit("The answer is "), F.substring(F.lit("ABCD"), F.pmod("doc_id", F.lit(4)).cast("int") + 1, 1))).when(F.pmod("doc_id", F.lit(5)) == 1, F.lit(r"so \boxed{c}")).when(F.pmod("doc_id", F.lit(5)) == 2, F.lit("maybe\nB) it")).when(F.pmod("doc_id", F.lit(5)) == 3, F.lit("**d** or a or B.")).otherwise(F.substring(F.col("text"), 1, 40)))).alias("answer")), documents),
    "str05_code_block": _each(lambda d: d.select("doc_id", T.first_code_block(F.when(F.pmod("doc_id", F.lit(2)) == 0, F.concat(F.lit("see\n```python\n"), F.col("text"), F.lit("\n```\nend ```py\nz```"))).otherwise(F.col("text"))).alias("code")), documents),
    "str06_response_checks": _each(lambda d: response_checks(d.where("role = 'assistant'"), "text", **CHECKS).select("conv_id", "turn", F.array_join("failures", ",").alias("failures")), conversations),
    "str07_sentences": _each(lambda d: d.select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n")), documents),
    "str11_as_text": _each(lambda d: d.select("item_id", T.as_text(F.when(F.pmod("item_id", F.lit(3)) != 0, F.concat(F.lit(" \n"), F.col("text"), F.lit("\t")))).alias("text")), benchmark),
    "arr02_ngrams": _each(lambda d: d.select("item_id", T.ngrams(T.plain_tokens(F.col("text")), 3).alias("grams")).select("item_id", F.size("grams").cast("long").alias("n"), F.array_join("grams", "|").alias("joined")), benchmark),
    "met01_rouge_1": _pairs(lambda p: rouge_n(p, 1)),
    "met01_rouge_2": _pairs(lambda p: rouge_n(p, 2)),
    "met02_rouge_l": _pairs(lambda p: rouge_l(p)),
    "met03_sentence_bleu": _pairs(sentence_bleu),
    "met04_corpus_bleu": _pairs(corpus_bleu),
    "met05_distinct_n": _each(distinct_n, benchmark),
    "met06_self_bleu": _each(lambda d: self_bleu(d.where("role = 'assistant'"), "conv_id", "turn", "text"), conversations),
    "met07_unigram_entropy": _each(lambda d: gram_entropy(d, 1), documents),
    "met07_bigram_entropy": _each(lambda d: gram_entropy(d, 2), documents),
    "met08_repetition_rate": _each(lambda d: d.select("doc_id", F.round(T.repetition_rate(T.plain_tokens(F.col("text")), 4), 9).alias("rate")), documents),
    "met11_trigram_variety": _each(lambda d: d.select("doc_id", F.round(T.trigram_variety(F.col("text")), 9).alias("score")), documents),
    "met12_length_score": _each(lambda d: d.select("doc_id", F.round(T.length_score(F.col("text")), 9).alias("score")), documents),
    "met13_coherence": _each(lambda d: d.select("doc_id", F.round(T.coherence_score(F.col("text")), 9).alias("score")), documents),
    "met14_topic_drift": _pairs(lambda p: p.select("conv_id", "turn", F.round(T.topic_score(F.col("reference"), F.col("candidate")), 9).alias("score"))),
    "met15_language_quality": _pairs(lambda p: p.select("conv_id", "turn", F.round(T.language_quality(F.col("reference"), F.col("candidate")), 9).alias("score"))),
    "met16_choice_rewards": _each(lambda d: d.select("doc_id", F.concat(F.lit("the answer is "), F.substring(F.lit("abcd"), F.pmod("doc_id", F.lit(4)).cast("int") + 1, 1)).alias("c"), F.substring(F.lit("ABCD"), F.pmod("doc_id", F.lit(3)).cast("int") + 1, 1).alias("answer")).select("doc_id", F.round(F.when(T.choice_answer(F.col("c")) == F.col("answer"), 1.0).otherwise(0.0) + 0.1 * F.when(T.has_answer_format(F.col("c")), 0.5).otherwise(0.0), 6).alias("reward")), documents),
    "met22_chat_repetition": _each(lambda d: d.where("role = 'assistant'").select("conv_id", "turn", T.chat_words(F.col("text")).alias("w")).select("conv_id", "turn", F.size("w").cast("long").alias("words"), F.round(F.size(F.array_distinct(T.ngrams(F.col("w"), 2))) / F.greatest(F.size(T.ngrams(F.col("w"), 2)), F.lit(1)), 6).alias("distinct_2"), (F.size(T.ngrams(F.col("w"), 3)) - F.size(F.array_distinct(T.ngrams(F.col("w"), 3)))).cast("long").alias("repeated_trigrams")), conversations),
}

_A = f"""CASE doc_id % 5 WHEN 0 THEN 'The answer is ' || substr('ABCD', doc_id % 4 + 1, 1) WHEN 1 THEN 'so \\boxed{{c}}' WHEN 2 THEN 'maybe' || chr(10) || 'B) it' WHEN 3 THEN '**d** or a or B.' ELSE substr(text, 1, 40) END"""
_T3 = D.ngrams("t", 3)
_COH = f"""(CASE WHEN regexp_matches(x, '[.!?]') THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN len(list_filter(regexp_split_to_array(x, {quoted(rf'[.!?][{S}]+')}), lambda s: regexp_matches(s, '^\\p{{Lu}}'))) > 0 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END
 + CASE WHEN length(x) > 0 AND length({D.replace('x', rf"[a-zA-Z0-9{S}.,!?;:'" + chr(34) + r"()\-]", "")}) / greatest(length(x), 1) < 0.1 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN len(t) >= 5 AND len(list_distinct(t)) / greatest(len(t), 1) > 0.4 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END)"""
_VAR = f"(CASE WHEN len(t) < 5 THEN 0.0::DOUBLE ELSE len(list_distinct({_T3})) / greatest(len({_T3}), 1) END)"
_LEN = "(CASE WHEN len(t) < 5 THEN 0.0::DOUBLE WHEN len(t) < 20 THEN len(t) / 20 WHEN len(t) <= 200 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - (len(t) - 200) / 200) END)"
_STOP = "[" + ", ".join(quoted(w) for w in T.STOP_WORDS) + "]"


def _content(x: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({x}), '([a-z]{{4,}})', 1)), lambda w: NOT list_contains({_STOP}, w))"


_TOPIC = """topic AS (SELECT *, len(list_intersect({0}, asked)) / greatest(len(asked), 1) AS f, len(list_intersect({1}, asked)) / greatest(len(asked), 1) AS s FROM (SELECT *, {2} AS asked, {3} AS w FROM pairs))""".format(
    _content("array_to_string(w[1:len(w) // 2], ' ')"), _content("array_to_string(w[len(w) // 2 + 1:], ' ')"), _content("reference"), D.split("candidate")
)
_DRIFT = "(CASE WHEN len(asked) = 0 OR len(w) < 20 THEN 1.0::DOUBLE WHEN f > 0 THEN least(1.0::DOUBLE, s / f) ELSE least(1.0::DOUBLE, s * 5) END)"
_LINES = f"list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, {quoted(rf'^[{S}]*[-*][{S}]+[^{S}]')}))"

ORACLES: dict[str, str] = {
    "flt03_clean_text": f"SELECT doc_id, {D.clean('text')} AS cleaned FROM documents WHERE {D.clean('text')} IS NOT NULL",
    "str08_strip_pages": f"SELECT page_id, {D.clean('html', 1)} AS cleaned FROM pages",
    "flt04_pipeline": f"SELECT source, count(*) AS docs, CAST(sum(length(t)) AS BIGINT) AS chars FROM (SELECT source, {D.clean('text')} AS t FROM documents) WHERE t IS NOT NULL AND len({D.split('t')}) >= 20 AND source <> 'src0' GROUP BY source",
    "flt05_instruction_keep": f"{PAIRS} SELECT conv_id, turn, length(reference) BETWEEN 3 AND 900 AND length(candidate) BETWEEN 3 AND 900 AND NOT (contains(lower(reference || chr(10) || candidate), '<image') OR contains(lower(reference || chr(10) || candidate), '![') OR contains(lower(reference || chr(10) || candidate), 'http://') OR contains(lower(reference || chr(10) || candidate), 'https://')) AS keep FROM pairs",
    "flt06_emit_guard": f"{PAIRS} SELECT conv_id, turn FROM pairs WHERE length({D.strip('reference')}) >= 3 AND length({D.strip('candidate')}) >= 2",
    "flt08_must_contain": "SELECT doc_id FROM documents WHERE contains(text, '@')",
    "str01_metric_tokens": f"SELECT doc_id, len(t) AS n, array_to_string(t, ' ') AS joined FROM (SELECT doc_id, {D.metric_tokens('text')} AS t FROM documents)",
    "str02_plain_tokens": f"SELECT doc_id, len({D.plain_tokens('text')}) AS n FROM documents",
    "str03_opening_key": f"SELECT array_to_string(({D.split(D.replace('lower(text)', r'[^\p{L}\p{N}]+', ' '), ' ')})[1:2], ' ') AS opening, count(*) AS docs FROM documents GROUP BY 1",
    "str04_choice_answer": f"""SELECT doc_id, upper(coalesce(nullif(regexp_extract(x, {quoted(rf'(?i)(?:the[{S}]+)?answer[{S}]*(?:is|:)[{S}]*([A-D])(?:[^{W}]|$)')}, 1), ''), nullif(regexp_extract(x, '\\\\boxed\\{{([A-Da-d])\\}}', 1), ''),
        nullif(regexp_extract({D.strip('x')}, {quoted(rf'(?m)^([A-Da-d])[).{S}]')}, 1), ''), nullif(regexp_extract(x, '\\*\\*([A-Da-d])\\*\\*', 1), ''), list_extract(regexp_extract_all({D.replace("' ' || x || ' '", rf'([^{W}])', r'\1\1')}, {quoted(rf'[^{W}]([A-Da-d])[^{W}]')}, 1), -1))) AS answer FROM (SELECT doc_id, 'x ' || {_A} AS x FROM documents)""",
    "str05_code_block": f"""SELECT doc_id, {D.strip("CASE WHEN regexp_matches(x, p) THEN regexp_extract(x, '(?is)```(?:python|py)?[ \\t\\r\\f]*\\n(.*?)```', 1) ELSE x END")} AS code FROM (SELECT doc_id, '(?is)```(?:python|py)?[ \\t\\r\\f]*\\n(.*?)```' AS p, CASE WHEN doc_id % 2 = 0 THEN 'see' || chr(10) || '```python' || chr(10) || text || chr(10) || '```' || chr(10) || 'end ```py' || chr(10) || 'z```' ELSE text END AS x FROM documents)""",
    "str06_response_checks": f"""SELECT conv_id, turn, array_to_string(CASE WHEN {D.strip('text')} = '' THEN ['empty_response'] ELSE list_filter([
        CASE WHEN NOT (contains(lower(text), 'the') AND contains(lower(text), 'ing')) THEN 'missing_all' END, CASE WHEN NOT (contains(lower(text), 'tion') OR contains(lower(text), 'eau')) THEN 'missing_any' END,
        CASE WHEN NOT regexp_matches(text, '(^|[^0-9])42($|[^0-9])') THEN 'missing_number:42' END, CASE WHEN NOT regexp_matches(text, '(^|[^0-9])7($|[^0-9])') THEN 'missing_number:7' END,
        CASE WHEN len({_WORDS}) > 60 THEN 'too_many_words:' || len({_WORDS}) END, CASE WHEN len({_LINES}) <> 0 THEN 'bullet_count:' || len({_LINES}) END,
        CASE WHEN len(list_filter({_LINES}, lambda s: len(regexp_extract_all(regexp_replace(s, {quoted(rf'^[{S}]*[-*][{S}]+')}, ''), {quoted(rf'([{W}' + chr(39) + ']+)')}, 1)) > 8)) > 0 THEN 'long_bullets' END], lambda z: z IS NOT NULL) END, ',') AS failures FROM conversations WHERE role = 'assistant'""",
    "str07_sentences": f"SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: {D.strip('s')}), lambda s: s <> '')) AS n FROM documents",
    "str11_as_text": f"SELECT item_id, {D.strip("coalesce(CASE WHEN item_id % 3 <> 0 THEN ' ' || chr(10) || text || chr(9) END, '')")} AS text FROM benchmark",
    "arr02_ngrams": f"SELECT item_id, len(g) AS n, array_to_string(g, '|') AS joined FROM (SELECT item_id, {_T3} AS g FROM (SELECT item_id, {D.plain_tokens('text')} AS t FROM benchmark))",
    "met01_rouge_1": _rouge_sql(1),
    "met01_rouge_2": _rouge_sql(2),
    "met03_sentence_bleu": f"{_orders_sql()}, s AS (SELECT conv_id, turn, min(p) AS low, avg(CASE WHEN p > 0 THEN ln(p) END) AS mean, max(len_candidate) AS c, max(len_reference) AS r FROM (SELECT *, CASE WHEN total = 0 THEN 1.0::DOUBLE / (len_candidate + 1) ELSE common / greatest(total, 1) END AS p FROM parts) GROUP BY ALL) SELECT conv_id, turn, round(CASE WHEN c = 0 OR low <= 0 THEN 0.0::DOUBLE ELSE exp(mean) * least(1.0::DOUBLE, exp(1 - r / greatest(c, 1))) END, 6) AS bleu FROM s",
    "met04_corpus_bleu": f"{_orders_sql()}, s AS (SELECT n, sum(common) AS common, sum(total) AS total, sum(len_candidate) AS lc, sum(len_reference) AS lr FROM parts GROUP BY n) SELECT round(CASE WHEN max(lc) = 0 OR min(common) = 0 OR min(total) = 0 THEN 0.0::DOUBLE ELSE exp(avg(ln(common / total))) * least(1.0::DOUBLE, exp(1 - max(lr) / max(lc))) END, 6) AS bleu FROM s",
    "met05_distinct_n": " UNION ALL ".join(f"SELECT {n} AS n, count(DISTINCT g) AS distinct_grams, count(*) AS grams, round(count(DISTINCT g) / count(*), 9) AS ratio FROM (SELECT unnest({D.ngrams('t', n)}) AS g FROM (SELECT {D.plain_tokens('text')} AS t FROM benchmark))" for n in range(1, 5)),
    "met06_self_bleu": "WITH tok AS (SELECT conv_id, turn, " + D.plain_tokens("text") + " AS t FROM conversations WHERE role = 'assistant'), " + ", ".join(f"k{n} AS (SELECT conv_id, turn, g, count(*) AS k FROM (SELECT conv_id, turn, unnest({D.ngrams('t', n)}) AS g FROM tok WHERE len(t) > 0) GROUP BY ALL)" for n in (1, 2)) + " " + " UNION ALL ".join(f"SELECT conv_id, {n} AS n, CAST(sum(least(k, o)) AS BIGINT) AS common, CAST(sum(k) AS BIGINT) AS total, count(DISTINCT turn) AS texts FROM (SELECT a.*, coalesce((SELECT max(b.k) FROM k{n} b WHERE b.conv_id = a.conv_id AND b.g = a.g AND b.turn <> a.turn), 0) AS o FROM k{n} a) GROUP BY conv_id" for n in (1, 2)),
    "met07_unigram_entropy": f"SELECT CAST(sum(c) AS BIGINT) AS total, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) AS entropy FROM (SELECT count(*) AS c FROM (SELECT unnest({D.plain_tokens('text')}) AS g FROM documents) GROUP BY g)",
    "met07_bigram_entropy": f"SELECT CAST(sum(c) AS BIGINT) AS total, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) AS entropy FROM (SELECT count(*) AS c FROM (SELECT unnest({D.ngrams('t', 2)}) AS g FROM (SELECT {D.plain_tokens('text')} AS t FROM documents)) GROUP BY g)",
    "met08_repetition_rate": f"SELECT doc_id, round(CASE WHEN len(t) < 4 THEN 0.0::DOUBLE ELSE 1 - len(list_distinct({D.ngrams('t', 4)})) / greatest(len(t) - 3, 1) END, 9) AS rate FROM (SELECT doc_id, {D.plain_tokens('text')} AS t FROM documents)",
    "met11_trigram_variety": f"SELECT doc_id, round({_VAR}, 9) AS score FROM (SELECT doc_id, {D.plain_tokens('text')} AS t FROM documents)",
    "met12_length_score": f"SELECT doc_id, round({_LEN}, 9) AS score FROM (SELECT doc_id, {D.plain_tokens('text')} AS t FROM documents)",
    "met13_coherence": f"SELECT doc_id, round({_COH}, 9) AS score FROM (SELECT doc_id, text AS x, {D.plain_tokens('text')} AS t FROM documents)",
    "met14_topic_drift": f"{PAIRS}, {_TOPIC} SELECT conv_id, turn, round({_DRIFT}, 9) AS score FROM topic",
    "met15_language_quality": f"{PAIRS}, {_TOPIC} SELECT conv_id, turn, round(CASE WHEN length(x) < 3 THEN 0.0::DOUBLE ELSE 0.25::DOUBLE * {_VAR} + 0.15::DOUBLE * {_LEN} + 0.25::DOUBLE * {_COH} + 0.2::DOUBLE * (CASE WHEN length(reference) > 0 THEN {_DRIFT} ELSE 1.0::DOUBLE END) + 0.15::DOUBLE * (CASE WHEN len(t) >= 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) END, 9) AS score FROM (SELECT *, {D.strip('candidate')} AS x, {D.plain_tokens('candidate')} AS t FROM topic)",
    "met16_choice_rewards": "SELECT doc_id, round(CASE WHEN doc_id % 4 = doc_id % 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + 0.1::DOUBLE * 0.5::DOUBLE, 6) AS reward FROM documents",
    "met22_chat_repetition": f"SELECT conv_id, turn, len(t) AS words, round(len(list_distinct({D.ngrams('t', 2)})) / greatest(len({D.ngrams('t', 2)}), 1), 6) AS distinct_2, len({_T3}) - len(list_distinct({_T3})) AS repeated_trigrams FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), {quoted(rf'([{W}' + chr(39) + ']+)')}, 1) AS t FROM conversations WHERE role = 'assistant')",
}
