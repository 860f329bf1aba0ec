"""Deterministic hash routes of token ids to experts, as tables built with integer arithmetic, and their diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..dual import Book

BOOK = Book()
add, both = BOOK.add, BOOK.both
MASK = 0xFFFFFFFF
# The multipliers of the 32-bit mixer and the salts of layers, channels and strides.
MIX_A, MIX_B = 0x7FEB352D, 0x846CA68B
LAYER, CHANNEL, EXPERT = 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D
SEED = 0x71D5A17


def u32(x: Column) -> Column:
    return x.bitwiseAND(F.lit(MASK))


def multiply32(x: Column, by: int) -> Column:
    """x * by mod 2^32 for 32-bit x, without a product over 63 bits: the halves of x are multiplied apart."""
    low = x.bitwiseAND(F.lit(65535)) * F.lit(by)
    high = (F.shiftright(x, 16) * F.lit(by & 65535)).bitwiseAND(F.lit(65535))
    return u32(low + F.shiftleft(high, 16))


def mix32(x: Column) -> Column:
    from ..functions.text import let

    def shifted(y: Column, n: int) -> Column:
        return let(y, lambda v: v.bitwiseXOR(F.shiftright(v, n)))

    x = shifted(u32(x.cast("long")), 16)
    x = shifted(let(x, lambda v: multiply32(v, MIX_A)), 15)
    return shifted(let(x, lambda v: multiply32(v, MIX_B)), 16)


def _tokens(spark: SparkSession, vocab: int) -> DataFrame:
    return spark.range(vocab).withColumnRenamed("id", "token")


def _ranked(df: DataFrame, top_k: int) -> DataFrame:
    return df.withColumn("route", F.explode(F.sequence(F.lit(0), F.lit(top_k - 1))))


def affine_routes(spark: SparkSession, vocab: int, experts: int, top_k: int, layer: int = 0, seed: int = SEED) -> DataFrame:
    """(token, route, expert): a hashed base plus route times an odd hashed stride, modulo a power of two."""
    salt = (seed + layer * LAYER) & MASK
    t = F.col("token")
    base = F.pmod(mix32(t.bitwiseXOR(F.lit(salt))), F.lit(experts))
    stride = F.pmod(mix32(t + F.lit(salt ^ CHANNEL)).bitwiseOR(F.lit(1)), F.lit(experts))
    rows = _tokens(spark, vocab).withColumns({"base": base, "stride": stride})
    return _ranked(rows, top_k).select("token", "route", F.pmod(F.col("base") + F.col("route") * F.col("stride"), F.lit(experts)).alias("expert"))


def multi_hash_routes(spark: SparkSession, vocab: int, experts: int, top_k: int, hashes: int = 4, layer: int = 0, seed: int = SEED) -> DataFrame:
    """(token, route, expert): the top_k experts by the sum of hashed scores over channels; ties to the lower expert."""
    salt = (seed + layer * LAYER) & MASK
    scores = F.lit(0).cast("long")
    for h in range(hashes):
        channel = (salt + h * CHANNEL) & MASK
        expert_salt = mix32(F.col("expert") + F.lit(channel ^ EXPERT))
        scores = scores + mix32(F.col("token").bitwiseXOR(expert_salt).bitwiseXOR(F.lit(channel)))
    rows = _tokens(spark, vocab).withColumn("expert", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(experts - 1).cast("long")))).withColumn("score", scores)
    rank = F.row_number().over(Window.partitionBy("token").orderBy(F.desc("score"), "expert")) - 1
    return rows.withColumn("route", rank).where(F.col("route") < top_k).select("token", "route", "expert")


def modulo_routes(spark: SparkSession, vocab: int, experts: int, top_k: int, layer: int = 0, seed: int = SEED) -> DataFrame:
    """(token, route, expert): the token modulo experts, permuted by a layer's seeded hash order, and its successors."""
    order = sorted(range(experts), key=lambda e: (mix32_int(e ^ ((seed ^ 0xC0DE) + layer * LAYER) & MASK), e))
    permuted = F.get(F.array(*[F.lit(e).cast("long") for e in order]), F.pmod(F.col("token"), F.lit(experts)).cast("int"))
    return _ranked(_tokens(spark, vocab), top_k).select("token", "route", F.pmod(permuted + F.col("route"), F.lit(experts)).alias("expert"))


def balanced_routes(spark: SparkSession, vocab: int, experts: int, top_k: int, layer: int = 0, seed: int = SEED) -> DataFrame:
    """(token, route, expert): tokens in hashed order; each run of `experts` uses every expert once at every route."""
    salt = (seed + layer * LAYER) & MASK
    order = Window.orderBy(mix32(F.col("token").bitwiseXOR(F.lit(salt))), "token")  # a vocabulary is a bounded table
    rows = _tokens(spark, vocab).withColumn("rank", (F.row_number().over(order) - 1).cast("long"))
    group, position = F.floor(F.col("rank") / experts), F.pmod("rank", F.lit(experts))
    odd = max(1, experts // 2)
    stride = 2 * F.pmod(mix32(group + F.lit(salt)), F.lit(odd)) + 1
    rows = _ranked(rows.withColumns({"position": position, "stride": stride}), top_k)
    return rows.select("token", "route", F.pmod(F.col("position") + F.col("route") * F.col("stride"), F.lit(experts)).alias("expert"))


def expand_routes(routes: DataFrame, experts: int, target: int, layer: int = 0, seed: int = SEED) -> DataFrame:
    """Each parent expert's routes dealt by hash over its clones: parent + clone * experts."""
    salt = (seed + layer * LAYER) & MASK
    wide = lambda c, by: u32(multiply32(F.col(c).cast("long"), by & MASK))
    clone = F.pmod(mix32(F.col("token").bitwiseXOR(wide("expert", CHANNEL)).bitwiseXOR(wide("route", EXPERT)).bitwiseXOR(F.lit(salt))), F.lit(target // experts))
    return routes.withColumn("expert", F.col("expert") + clone * experts)


def route_faults(routes: DataFrame, experts: int, top_k: int) -> DataFrame:
    """Tokens with a wrong number of routes, an expert out of range, or one expert twice."""
    per = routes.groupBy("token").agg(F.count("*").alias("n"), F.count_distinct("expert").alias("d"), F.min("expert").alias("low"), F.max("expert").alias("high"))
    return per.where((F.col("n") != top_k) | (F.col("d") != F.col("n")) | (F.col("low") < 0) | (F.col("high") >= experts))


def pair_codes(routes: DataFrame, experts: int) -> DataFrame:
    """(token, code): the index of an unordered pair of experts and a bit for its order (bit 3 up to 8 pairs, else bit 5)."""
    wide = routes.groupBy("token").agg(F.max(F.when(F.col("route") == 0, F.col("expert"))).alias("a"), F.max(F.when(F.col("route") == 1, F.col("expert"))).alias("b"))
    low, high = F.least("a", "b"), F.greatest("a", "b")
    index = (low * (2 * experts - low - 1) / 2 + high - low - 1).cast("long")
    bit = 8 if experts * (experts - 1) // 2 <= 8 else 32
    return wide.select("token", "a", "b", (index + F.when(F.col("a") > F.col("b"), bit).otherwise(0)).alias("code"))


def mix32_int(x: int) -> int:
    x &= MASK
    x ^= x >> 16
    x = x * MIX_A & MASK
    x ^= x >> 15
    x = x * MIX_B & MASK
    return x ^ x >> 16


# ---- twins ---------------------------------------------------------------------------------------------------------


def _mix(x: str) -> str:
    x = f"(CAST({x} AS BIGINT) & {MASK})"
    x = f"xor({x}, {x} >> 16)"
    x = f"CAST((CAST({x} AS HUGEINT) * {MIX_A}) % 4294967296 AS BIGINT)"
    x = f"xor({x}, {x} >> 15)"
    x = f"CAST((CAST({x} AS HUGEINT) * {MIX_B}) % 4294967296 AS BIGINT)"
    return f"xor({x}, {x} >> 16)"


def _affine_sql(vocab: int, experts: int, top_k: int) -> str:
    return f"SELECT token, CAST(route AS INTEGER) AS route, (base + route * stride) % {experts} AS expert FROM (SELECT token, {_mix(f'xor(token, {SEED})')} % {experts} AS base, ({_mix(f'token + {SEED ^ CHANNEL}')} | 1) % {experts} AS stride FROM range({vocab}) t(token)), range({top_k}) r(route)"


def _multi_sql(vocab: int, experts: int, top_k: int, hashes: int) -> str:
    total = " + ".join(_mix(f"xor(xor(token, es{h}), {(SEED + h * CHANNEL) & MASK})") for h in range(hashes))
    salts = ", ".join(f"{_mix(f'expert + {((SEED + h * CHANNEL) & MASK) ^ EXPERT}')} AS es{h}" for h in range(hashes))
    return f"SELECT token, CAST(r - 1 AS INTEGER) AS route, expert FROM (SELECT token, expert, row_number() OVER (PARTITION BY token ORDER BY score DESC, expert) AS r FROM (SELECT token, expert, {total} AS score FROM range({vocab}) t(token), (SELECT expert, {salts} FROM range({experts}) e(expert)))) WHERE r <= {top_k}"


V, E_, K_ = 512, 8, 2
add("mth01_mix32", lambda s, d: s.range(1000).select("id", mix32(F.col("id") * 4_294_967).alias("h")), f"SELECT id, {_mix('id * 4294967')} AS h FROM range(1000) t(id)")
add("rte01_affine_routes", lambda s, d: affine_routes(s, V, E_, K_), _affine_sql(V, E_, K_))
add("rte02_multi_hash_routes", lambda s, d: multi_hash_routes(s, V, E_, K_, 3), _multi_sql(V, E_, K_, 3))
_ORDER = sorted(range(E_), key=lambda e: (mix32_int(e ^ (SEED ^ 0xC0DE) & MASK), e))
add("rte03_modulo_routes", lambda s, d: modulo_routes(s, V, E_, K_), f"SELECT token, CAST(route AS INTEGER) AS route, CAST(({_ORDER}[token % {E_} + 1] + route) % {E_} AS BIGINT) AS expert FROM range({V}) t(token), range({K_}) r(route)")
_BALANCED = f"SELECT token, route, (position + route * (2 * ({_mix(f'grp + {SEED}')} % {E_ // 2}) + 1)) % {E_} AS expert FROM (SELECT token, (row_number() OVER (ORDER BY {_mix(f'xor(token, {SEED})')}, token) - 1) // {E_} AS grp, (row_number() OVER (ORDER BY {_mix(f'xor(token, {SEED})')}, token) - 1) % {E_} AS position FROM range({V}) t(token)), range({K_}) r(route)"
add("rte04_balanced_routes", lambda s, d: balanced_routes(s, V, E_, K_), f"SELECT token, CAST(route AS INTEGER) AS route, expert FROM ({_BALANCED})")
_CLONE = _mix(f"xor(xor(xor(token, CAST((CAST(expert AS HUGEINT) * {CHANNEL}) % 4294967296 AS BIGINT)), CAST((CAST(route AS HUGEINT) * {EXPERT}) % 4294967296 AS BIGINT)), {SEED})")
add("rte05_hierarchical_routes", lambda s, d: expand_routes(balanced_routes(s, V, E_, K_), E_, 2 * E_), f"SELECT token, CAST(route AS INTEGER) AS route, expert + ({_CLONE} % 2) * {E_} AS expert FROM ({_BALANCED})")
add("rte06_route_invariants", lambda s, d: multi_hash_routes(s, V, E_, K_, 3).agg(F.count_distinct("token").alias("tokens")).crossJoin(route_faults(multi_hash_routes(s, V, E_, K_, 3), E_, K_).agg(F.count("*").alias("faults"))), f"SELECT {V}::BIGINT AS tokens, 0::BIGINT AS faults")
add("rte07_pair_codes", lambda s, d: pair_codes(affine_routes(s, V, E_, 2), E_).where("a <> b").select("token", "code"), f"SELECT token, CAST(low * (2 * {E_} - low - 1) / 2 + high - low - 1 AS BIGINT) + CASE WHEN a > b THEN 32 ELSE 0 END AS code FROM (SELECT token, a, b, least(a, b) AS low, greatest(a, b) AS high FROM (SELECT token, max(CASE WHEN route = 0 THEN expert END) AS a, max(CASE WHEN route = 1 THEN expert END) AS b FROM ({_affine_sql(V, E_, 2)}) GROUP BY token)) WHERE a <> b")
add("rte08_expert_expansion", lambda s, d: expand_routes(affine_routes(s, V, E_, K_), E_, 4 * E_).groupBy("expert").agg(F.count("*").alias("n")), f"SELECT expert + ({_CLONE} % 4) * {E_} AS expert, count(*) AS n FROM ({_affine_sql(V, E_, K_)}) GROUP BY 1")
add("jon11_token_routes", lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.pmod("l_partkey", F.lit(V)).alias("token")).join(F.broadcast(affine_routes(s, V, E_, 1)), "token").groupBy("expert").agg(F.count("*").alias("n")), f"SELECT r.expert, count(*) AS n FROM lineitem JOIN ({_affine_sql(V, E_, 1)}) r ON r.token = l_partkey % {V} GROUP BY r.expert")
both("tok06_special_ids", "SELECT o_orderkey AS id, CASE WHEN o_orderkey = 0 THEN '<|unk|>' WHEN o_orderkey = 1 THEN '<|begin|>' WHEN o_orderkey = 2 THEN '<|end|>' ELSE '<|reserved_' || CAST(o_orderkey AS STR) || '|>' END AS token FROM {orders} WHERE o_orderkey < 2048")

QUERIES, ORACLES = BOOK.queries, BOOK.oracles
