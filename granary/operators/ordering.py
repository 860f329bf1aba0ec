"""Positions, quantiles and running sums over a whole table without a window that holds the whole table."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch


def numbered(df: DataFrame, *order: Column | str, out: str = "position") -> DataFrame:
    """Adds the row's position from 0 in the order of the whole table; the order must be total for it to be determined.

    Rows are dealt by ranges of the order and written, so that the ranges stay as they are; the rows before a range are the sum
    of the ranges before it, one number for each, and a row's place within its range is a window over that range.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(spark, "numbered")
    df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    # a number for each partition
    return ranged.withColumn("_place", place).join(F.broadcast(before), "_range").withColumn(out, F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")


def numbered_within(df: DataFrame, keys: list[str], *order: Column | str, out: str = "position") -> DataFrame:
    """Adds the row's position from 0 among the rows of its keys; few keys with most of the rows are spread like any others.

    Rows are numbered over the whole table by (keys, order), and each key's first number is taken off: a row for each key.
    """
    rows = numbered(df, *keys, *order, out="_all")
    first = rows.groupBy(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)]).agg(F.min("_all").alias("_first"))
    same = [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)]
    joined = rows.join(first, reduce(and_, same))
    return joined.withColumn(out, F.col("_all") - F.col("_first")).drop("_all", "_first", *[f"_key_{i}" for i in range(len(keys))])


def nearest_rank(df: DataFrame, value: str, fractions: dict[str, float], tie: str, half_even: bool = True) -> DataFrame:
    """One row with the value at index round((n - 1) * f) of the sorted values, or floor(n * f) without half_even."""
    total = df.count()
    at = {name: round((total - 1) * f) if half_even else min(int(total * f), total - 1) for name, f in fractions.items()}
    rows = numbered(df.select(value, tie), value, tie)
    return rows.agg(*[F.max(F.when(F.col("position") == i, F.col(value))).alias(name) for name, i in at.items()])


def cut_of_hash(df: DataFrame, digest: Column, count: int) -> str:
    """The count-th smallest hex digest: counts by the first four digits find its bucket, and only that bucket is ordered."""
    if count <= 0:
        return ""
    rows = df.select(digest.alias("h"))
    buckets = rows.groupBy(F.substring("h", 1, 4).alias("b")).agg(F.count("*").alias("n")).orderBy("b").collect()  # 65,536 at most
    seen = 0
    for b, n in buckets:
        if seen + n >= count:
            return rows.where(F.substring("h", 1, 4) == b).orderBy("h").limit(count - seen).agg(F.max("h")).first()[0]
        seen += n
    return "g"


def zipped(left: DataFrame, left_order: str, right: DataFrame, right_order: str, out: str = "line") -> DataFrame:
    """Rows of two tables side by side by their positions; tables of different lengths raise."""
    if left.count() != right.count():
        raise ValueError("tables of different lengths can't be zipped")
    return numbered(left, left_order, out=out).join(numbered(right, right_order, out=out), out)
