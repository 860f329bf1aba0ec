"""Temperature mixing of sources to target weights, in DataFrame operations only.

Each source's share of all tokens is raised to an exponent and normalised.  The exponent is bisected between 0 (all sources
alike) and 1 (shares as they are): it is the largest one whose weights have at least the target entropy (a part of the greatest
possible), raised again if some source would then have to repeat more than the repetition limit allows.  The budget is given, or
else the smallest that keeps every row of every source once.

Weights become rows by budgeted block permutations.  A source's rows are dealt into blocks by the hash of their key; in every
pass over a source its blocks are permuted by a hash of (seed, pass, block).  Whole passes are taken as long as the budget of the
source lasts; of the last pass whole blocks, and of the block that the budget cuts the rows in hash order whose tokens still
fit.  A source with a third of all rows is split into as many blocks as its tokens and rows ask for.  Where the last pass ends is
found in two steps, first among sums over RANGES ranges of the permutation, then among the blocks of the range that the budget
cuts: no window holds more than RANGES sums, one range's blocks or one block's distinct rows of a source.

Rows of a null source are a source of their own.  Tokens are the words between white space; a row without words weighs 0 and
comes with its block.  Rows that repeat a doc_id and text keep their number: each is dealt on its own.  A null text is kept as
it is.  All columns of the input are kept, but for ones named mix_pass, mix_tokens and mix_order, whose place the result's own
columns take; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._core import read_table, written

ENTROPY, REPEATS, BLOCK_TOKENS, SEED = 0.97, 2.0, 200_000, 20250101
GRID, ROUNDS = 64, 4
#: Rows that a block has at most on average, and ranges (a power of 2) of a permutation whose sums are ordered first.
BLOCK_ROWS, RANGE_BITS = 10_000, 12
RANGES = 1 << RANGE_BITS


def _once(value: F.Column, body: Callable[[F.Column], F.Column]) -> F.Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def token_count(text: str = "text") -> F.Column:
    """Words between runs of white space; 0 for a null or empty text.

    White space becomes spaces by plain replacement, runs of spaces collapse where there are any, and the spaces left are
    counted as a difference of lengths: no list of words is made and no pattern is run over most texts.
    """
    x = F.coalesce(F.col(text).cast("string"), F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        x = F.replace(x, F.lit(c), F.lit(" "))
    x = _once(x, lambda y: F.trim(F.when(F.contains(y, F.lit("  ")), F.regexp_replace(y, " {2,}", " ")).otherwise(y)))
    spaces = _once(x, lambda y: F.when(y == "", F.lit(-1)).otherwise(F.octet_length(y) - F.octet_length(F.replace(y, F.lit(" "), F.lit("")))))
    return (spaces + 1).cast("long")


def exponent(sources: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS) -> float:
    """The exponent for sources(tokens), bisected on a grid of GRID steps in each of ROUNDS scans of a row per source.

    With weights w = share^a, normalised, entropy falls as a grows to 1, and so does the spread of w / share, which is how often
    the least damped source is repeated while the most damped one is given once.
    """
    sources = sources.where("tokens > 0")
    total, n = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    if n < 2:
        return 1.0

    def scan(low: float, high: float) -> tuple[list[float], list[float], list[float]]:
        grid = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a")) for i, a in enumerate(grid)]))
        powers = sources.select((F.col("tokens") / F.lit(float(total))).alias("p"), each.alias("g")).select("g.i", "p", F.pow("p", F.col("g.a")).alias("q"))
        q, p = F.col("q"), F.col("p")
        rows = powers.groupBy("i").agg((F.log(F.sum(q)) - F.sum(q * F.log(q)) / F.sum(q)).alias("h"), (F.max(q / p) / F.min(q / p)).alias("spread")).orderBy("i").collect()
        return grid, [r.h for r in rows], [r.spread for r in rows]

    level, limit = entropy * log(n), repeats * (1 + 1e-12)
    low, high, reach = 0.0, 1.0, None
    for _ in range(ROUNDS):  # the largest exponent with the entropy; low always has it
        grid, h, _ = scan(low, high)
        i = max((i for i in range(GRID + 1) if h[i] >= level), default=0)
        if i == GRID:
            reach = grid[GRID]
            break
        low, high = grid[i], grid[i + 1]
    reach = low if reach is None else reach
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):  # the smallest exponent within the repetition limit; high always is
        grid, _, spread = scan(low, high)
        i = min((i for i in range(GRID + 1) if spread[i] <= limit), default=GRID)
        low, high = grid[max(0, i - 1)], grid[i]
        if i == 0:
            break
    return max(reach, high)


def weights(sources: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None) -> DataFrame:
    """(source, tokens, share, weight, target, passes) of sources(source, tokens); target: tokens to give."""
    a = exponent(sources, entropy, repeats)
    total, = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()
    out = sources.withColumn("share", F.when(F.lit(total) > 0, F.col("tokens") / F.lit(float(total or 1))).otherwise(0.0))
    out = out.withColumn("_q", F.when(F.col("tokens") > 0, F.pow("share", F.lit(a))).otherwise(0.0))
    z, least = out.agg(F.sum("_q"), F.min(F.when(F.col("tokens") > 0, F.col("_q") / F.col("tokens")))).first()
    # the smallest budget that gives every source a whole pass has weight / share = 1 at the source that is damped most
    whole = F.lit(float(budget)) * F.col("_q") / F.lit(z or 1.0) if budget is not None else F.col("_q") / F.lit(least or 1.0)
    if budget is None:  # a whole pass may come out as one less a rounding of the bisection
        whole = F.when(F.abs(F.round(whole / F.col("tokens")) * F.col("tokens") - whole) < 1e-6 * F.col("tokens"), F.round(whole / F.col("tokens")) * F.col("tokens")).otherwise(whole)
    target = F.when(F.col("tokens") > 0, F.floor(whole * (1 + 1e-12)).cast("long")).otherwise(0)
    passes = F.when(F.col("tokens") > 0, whole / F.col("tokens")).otherwise(1.0)
    return out.withColumns({"weight": F.col("_q") / F.lit(z or 1.0), "passes": passes, "target": target}).drop("_q")


def _hash(*columns: object) -> F.Column:
    return F.xxhash64(F.lit(SEED), *columns)


def _block(source: str, key: str) -> F.Column:
    return F.pmod(_hash(F.lit("deal"), F.col(source), F.col(key)), F.col("n_blocks"))


def _order(passes: F.Column, source: str, block: str) -> F.Column:
    """The place of a block in the permutation of a pass."""
    return F.struct(_hash(passes.cast("long"), F.col(source), F.col(block)).alias("order"), F.col(block).alias("block"))


def plan(rows: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """For rows(key, source, tokens), a row for each source: its weight, blocks, whole passes and where the last pass ends.

    whole: the last block, in the permutation, that the last pass takes whole; cut: the next one, taken up to room tokens.
    """
    sources = written(rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows")), "sources")
    shares = weights(sources, entropy, repeats, budget)
    shares = shares.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.lit(block_tokens)), F.ceil(F.col("rows") / F.lit(BLOCK_ROWS))).cast("long"))
    shares = shares.withColumn("full", F.when(F.col("tokens") > 0, F.expr("target div tokens")).otherwise(1).cast("long"))
    shares = written(shares.withColumn("rest", F.when(F.col("tokens") > 0, F.col("target") - F.col("full") * F.col("tokens")).otherwise(0)), "shares")
    blocks = _with(rows, shares.where("rest > 0"), "source", "key", ["n_blocks", "full", "rest"]).groupBy("source", "block", "full", "rest").agg(F.sum("tokens").alias("size"))
    place = _order(F.col("full"), "source", "block")
    blocks = written(blocks.withColumn("place", place).withColumn("range", F.shiftright("place.order", 64 - RANGE_BITS)), "blocks")
    # the range that the budget cuts, and what the ranges before it have
    ranges = blocks.groupBy("source", "range", "rest").agg(F.sum("size").alias("size"))
    by_range = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("size").over(by_range), F.lit(0)))
    last = ranges.where("before < rest").groupBy("source").agg(F.max(F.struct("range", "before")).alias("last")).select(F.col("source").alias("_source"), F.col("last.range").alias("_range"), F.col("last.before").alias("_before"))
    blocks = blocks.join(last, F.col("source").eqNullSafe(F.col("_source")) & (F.col("range") == F.col("_range"))).drop("_source", "_range")
    before = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.col("_before") + F.coalesce(F.sum("size").over(before), F.lit(0))).where(F.col("before") < F.col("rest"))
    fits = F.col("before") + F.col("size") <= F.col("rest")
    ends = blocks.groupBy("source").agg(F.max(F.when(fits, F.col("place"))).alias("whole"), F.min("place").alias("least"), F.max(F.when(~fits, F.col("block"))).alias("cut"), F.max(F.when(~fits, F.col("rest") - F.col("before"))).alias("room"))
    # where the first block of the range is cut, all before it are whole: those of a lower place
    first = F.struct((F.col("least.order") - 1).alias("order"), F.col("least.block").alias("block"))
    lowest = F.lit(-(1 << 63)).cast("long")
    ends = ends.select(F.col("source").alias("_source"), F.coalesce("whole", F.when(F.col("least.order") > lowest, first)).alias("whole"), "cut", "room")
    return written(shares.join(ends, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source"), "plan")


def _with(rows: DataFrame, shares: DataFrame, source: str, key: str, take: list[str]) -> DataFrame:
    """rows with columns of their source's plan, a row for each source, and their block."""
    named = shares.select(F.col("source").alias("_plan"), *take)
    return rows.join(named, F.col(source).eqNullSafe(F.col("_plan"))).drop("_plan").withColumn("block", _block(source, key))


#: Rows taken from the blocks that a budget cuts (one block of each source) up to this number are broadcast.
BROADCAST_ROWS = 200_000


def mix(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """docs repeated and cut to the budget; adds mix_pass (from 0), mix_tokens and mix_order, the place in the permutation."""
    docs = docs.drop(*[c for c in docs.columns if c in {"mix_pass", "mix_tokens", "mix_order"}])
    names = docs.columns
    key = F.xxhash64(F.lit(SEED), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = written(docs.select(key.alias("key"), F.col("source").cast("string").alias("source"), token_count().alias("tokens")), "rows")
    made = plan(rows, entropy, repeats, budget, block_tokens)
    # rows of the block that the budget cuts, in hash order, as long as their running sum fits; equal rows go together
    cut = _with(rows, made.where("cut is not null"), "source", "key", ["n_blocks", "full", "cut", "room"]).where("block = cut")
    cut = cut.groupBy("source", "key", "full", "room").agg(F.sum("tokens").alias("tokens"))
    running = Window.partitionBy("source").orderBy(_hash(F.col("full"), F.col("key")), "key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    taken = cut.withColumn("sum", F.sum("tokens").over(running)).where(F.col("sum") <= F.col("room"))
    taken = written(taken.select(F.col("source").alias("_s"), F.col("key").alias("_k"), F.lit(True).alias("_hit")).distinct(), "taken")
    if taken.count() <= BROADCAST_ROWS:
        taken = F.broadcast(taken)
    doc = docs.withColumns({"_key": key, "_source": F.col("source").cast("string"), "mix_tokens": token_count()}).withColumnsRenamed({c: f"_own_{c}" for c in names})
    doc = _with(doc, made, "_source", "_key", ["n_blocks", "full", "whole"])
    doc = doc.join(taken, (F.col("_key") == F.col("_k")) & F.col("_source").eqNullSafe(F.col("_s")), "left")
    extra = (F.coalesce(_order(F.col("full"), "_source", "block") <= F.col("whole"), F.lit(False)) | F.coalesce("_hit", F.lit(False))).cast("int")
    doc = doc.withColumn("_n", (F.col("full") + extra).cast("int")).where("_n > 0")
    doc = doc.withColumn("mix_pass", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    order = F.struct(_order(F.col("mix_pass"), "_source", "block").alias("block"), _hash(F.col("mix_pass").cast("long"), F.col("_key")).alias("row"))
    return doc.select(*[F.col(f"_own_{c}").alias(c) for c in names], "mix_pass", "mix_tokens", order.alias("mix_order"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "mix_pass", "mix_tokens", F.col("mix_order.block.order").alias("block_rank"), F.col("mix_order.block.block").alias("block"), F.col("mix_order.row").alias("row_rank"))
