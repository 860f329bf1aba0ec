"""Measures of scores in groups: softmax, nucleus, ranks, contrastive loss, choices, mixtures, routing shares, precision and F1 curves."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .corpus import running_total
from .detection import State, average_precision
from .ordering import numbered_within


def softmax(rows: DataFrame, key: str, logit: Column, out: str = "p") -> DataFrame:
    """Adds the softmax of logit among the rows of a key; the largest logit is taken off first, so that none overflows."""
    group = Window.partitionBy(key)
    rows = rows.withColumn("_x", logit).withColumn("_e", F.exp(F.col("_x") - F.max("_x").over(group)))
    return rows.withColumn(out, F.col("_e") / F.sum("_e").over(group)).drop("_x", "_e")


def nucleus(rows: DataFrame, key: str, tie: str, logit: Column, mass: float) -> DataFrame:
    """The likeliest rows of a key, up to and with the one that reaches mass; p is their softmax."""
    before = F.sum("p").over(Window.partitionBy(key).orderBy(F.desc("p"), tie).rowsBetween(Window.unboundedPreceding, -1))
    return softmax(rows, key, logit).withColumn("_before", F.coalesce(before, F.lit(0.0))).where(F.col("_before") < mass - 1e-9).drop("_before")


def group_advantage(rows: DataFrame, key: str, value: str, eps: float = 1e-8) -> DataFrame:
    """Adds advantage, the value's distance from its group's mean in sample deviations; groups without spread, or of one row, go."""
    group = Window.partitionBy(key)
    spread = rows.withColumns({"_mean": F.avg(value).over(group), "_sd": F.stddev_samp(value).over(group)}).where(F.col("_sd") >= eps)
    return spread.withColumn("advantage", (F.col(value) - F.col("_mean")) / (F.col("_sd") + eps)).drop("_mean", "_sd")


def shares(rows: DataFrame, group: str, item: str) -> DataFrame:
    """(group, item, n, share): how a group's rows divide over items; groups and items are few, rows are summed map-side."""
    total = F.sum(F.count("*")).over(Window.partitionBy(group))  # over counts, not rows
    return rows.groupBy(group, item).agg(F.count("*").alias("n"), (F.count("*") / total).alias("share"))


def routing_entropy(rows: DataFrame, group: str, item: str, items: int) -> DataFrame:
    """(group, entropy): the entropy of a group's shares by that of even shares over all items."""
    return shares(rows, group, item).groupBy(group).agg((-F.sum(F.col("share") * F.log("share")) / F.log(F.lit(float(items)))).alias("entropy"))


def power_mixture(rows: DataFrame, source: str, exponent: float = 0.5) -> DataFrame:
    """(source, weight): shares of the sources' row counts raised to the exponent."""
    counts = rows.groupBy(source).agg(F.pow(F.count("*").cast("double"), F.lit(exponent)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))  # one row
    return counts.crossJoin(F.broadcast(total)).select(source, (F.col("_n") / F.col("_all")).alias("weight"))


def loss_weights(rows: DataFrame, task: str, tokens: str) -> DataFrame:
    """(task, tokens, weight): even shares of tasks by their shares of the tokens."""
    sums = rows.groupBy(task).agg(F.sum(tokens).alias("tokens"))
    total = sums.agg(F.count("*").alias("_k"), F.sum("tokens").alias("_all"))  # one row
    return sums.crossJoin(F.broadcast(total)).select(task, "tokens", (1.0 / F.col("_k") / (F.col("tokens") / F.col("_all"))).alias("weight"))


def retrieval(rows: DataFrame, query: str, score: str, wanted: Column) -> DataFrame:
    """(acc1, mrr) of the ranks of wanted rows among their query's; of equal scores all have the best rank."""
    ranked = rows.withColumn("_wanted", wanted).withColumn("_r", F.rank().over(Window.partitionBy(query).orderBy(F.desc(score))))
    return ranked.where("_wanted").agg(F.avg((F.col("_r") == 1).cast("double")).alias("acc1"), F.avg(1.0 / F.col("_r")).alias("mrr"))


def _log_sum(rows: DataFrame, key: str, score: Column, wanted: Column) -> DataFrame:
    """One row a key: lse, want (the wanted row's score), best (the best other one), above (rows over the wanted one)."""
    group = Window.partitionBy(key)
    rows = rows.select(key, score.alias("x"), wanted.alias("w"))
    rows = rows.withColumns({"top": F.max("x").over(group), "want": F.max(F.when(F.col("w"), F.col("x"))).over(group)})
    return rows.groupBy(key, "top", "want").agg(
        (F.col("top") + F.log(F.sum(F.exp(F.col("x") - F.col("top"))))).alias("lse"),
        F.max(F.when(~F.col("w"), F.col("x"))).alias("best"),
        F.sum(F.when(F.col("x") > F.col("want"), 1).otherwise(0)).alias("above"),
    )


def info_nce(rows: DataFrame, key: str, score: Column, positive: Column) -> DataFrame:
    """(loss): the mean negative log softmax of a query's positive; queries without one don't count."""
    return _log_sum(rows, key, score, positive).where("want is not null").agg(F.avg(F.col("lse") - F.col("want")).alias("loss"))


def recall_metrics(rows: DataFrame, key: str, logit: Column, wanted: Column) -> DataFrame:
    """(acc, mean_rank, margin, nll) of the wanted token of each row; the margin is to the best other token."""
    of = _log_sum(rows, key, logit, wanted)
    return of.agg(
        F.avg((F.col("above") == 0).cast("double")).alias("acc"),
        F.avg(1.0 + F.col("above")).alias("mean_rank"),
        F.avg(F.col("want") - F.col("best")).alias("margin"),
        F.avg(F.col("lse") - F.col("want")).alias("nll"),
    )


def top_k_accuracy(rows: DataFrame, key: str, score: str, tie: str, by: str, *ks: int) -> DataFrame:
    """(by, top<k>...): the share of rows that are among the first k of their key."""
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), tie)))
    return ranked.groupBy(by).agg(*[F.avg((F.col("_r") <= k).cast("double")).alias(f"top{k}") for k in ks])


def choice_accuracy(rows: DataFrame, key: str, choice: str, answer: Column, **scores: Column) -> DataFrame:
    """A column for each score: how often its best choice, of equal ones the first, is the answer; summed map-side."""
    best = [F.max(F.struct(x, (-F.col(choice)).alias("c"))).alias(name) for name, x in scores.items()]
    picked = rows.groupBy(key, answer.alias("_answer")).agg(*best)
    return picked.agg(*[F.avg((-F.col(name)["c"] == F.col("_answer")).cast("double")).alias(name) for name in scores])


def banned_next(rows: DataFrame, key: str, order: list[str], token: str, n: int = 2) -> DataFrame:
    """(key, banned): tokens that followed an earlier occurrence of the key's last n tokens."""
    along = Window.partitionBy(key).orderBy(*order)
    places = rows.select(key, F.col(token).alias("banned"), *[F.lag(token, i).over(along).alias(f"_{i}") for i in range(1, n + 1)], F.lead(F.lit(1)).over(along).alias("_next"))
    last = places.where("_next is null").select(key, *[F.col("banned" if i == 1 else f"_{i - 1}").alias(f"_last_{i}") for i in range(1, n + 1)])
    same = reduce(and_, [F.col(f"_{i}") == F.col(f"_last_{i}") for i in range(1, n + 1)])
    return places.join(last, key).where(same & F.col("banned").isNotNull()).select(key, "banned").distinct()


def class_precision(rows: DataFrame, label: str, score: str, ties: tuple[str, str], hit: Column) -> DataFrame:
    """(label, ap): area under the precision envelope of each class, by ranges of ranks."""
    flags = rows.select(F.lit("all").alias("scope"), F.col(label).alias("label"), F.col(score).alias("score"), F.col(ties[0]).alias("image"), F.col(ties[1]).alias("box"), F.array(hit).alias("hits"))
    counts = flags.groupBy("scope", "label").agg(F.sum(F.col("hits")[0].cast("long")).alias("targets"))
    return average_precision(State(flags, counts)).where("threshold = 0").select(F.col("label").alias(label), "ap")


def class_best_f1(rows: DataFrame, label: str, score: str, ties: tuple[str, str], hit: Column) -> DataFrame:
    """(label, f1): the largest F1 over the cuts of each class's score order; a cut before a miss is better than one after it."""
    ranked = numbered_within(rows.select(label, score, *ties, hit.alias("_hit")), [label], F.desc(score), *ties)
    hits = running_total(ranked.where("_hit").select(label, "position", F.lit(1).cast("long").alias("_one")), [label], "position", "_one")
    total = hits.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_t"))
    f1 = 2.0 * (F.col("before") + 1) / (F.col("position") + 1 + F.col("_t"))
    found = hits.join(total, F.col(label).eqNullSafe(F.col("_label"))).groupBy(label).agg(F.max(f1).alias("f1"))
    return rows.select(label).distinct().withColumnRenamed(label, "_all").join(found, F.col("_all").eqNullSafe(F.col(label)), "left").select(F.col("_all").alias(label), F.coalesce("f1", F.lit(0.0)).alias("f1"))


def profile(rows: DataFrame, group: str, value: str, tie: str, **fractions: float) -> DataFrame:
    """(group, <name>..., sd): the value at index floor(n * fraction) of each group's sorted values, and their sample deviation.

    Values are ranked by ranges of the whole table, so that a group that has most of the rows is spread.
    """
    ranked = numbered_within(rows.select(group, value, tie), [group], value, tie)
    sizes = rows.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("_n"))
    ranked = ranked.join(sizes, F.col(group).eqNullSafe(F.col("_group")))
    at = [F.max(F.when(F.col("position") == F.floor(F.col("_n") * f), F.col(value))).alias(name) for name, f in fractions.items()]
    return ranked.groupBy(group).agg(*at, F.stddev_samp(value).alias("sd"))


def following(rows: DataFrame, group: str, *order: str, value: str) -> DataFrame:
    """Adds before, the value of the group's previous row; rows are placed by ranges, not gathered by group."""
    placed = numbered_within(rows.select(group, *order, value), [group], *order)
    earlier = placed.select(F.col(group).alias("_group"), (F.col("position") + 1).alias("_at"), F.col(value).alias("before"))
    return placed.join(earlier, F.col(group).eqNullSafe(F.col("_group")) & (F.col("position") == F.col("_at")), "left").drop("_group", "_at", "position")


def exact_match(rows: DataFrame, by: str, candidate: str, reference: str) -> DataFrame:
    """(by, rate): the share of candidates that are their reference but for case and blanks around; a null is an empty text."""
    norm = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    return rows.groupBy(by).agg(F.avg((norm(candidate) == norm(reference)).cast("double")).alias("rate"))
