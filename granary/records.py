"""A set of records with the operations of a data-preparation script, over a DataFrame that is never collected."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators.relational import hash_split
from .sources import readers


class Records:
    """Records of one schema; every method gives new records."""

    def __init__(self, df: DataFrame):
        self.df = df

    @classmethod
    def load(cls, spark: SparkSession, path: str, schema: str = "text string", limit: int | None = None) -> Records:
        """From JSON lines, a JSON document, text or a folder, by suffix."""
        df = readers.load(spark, path, schema)
        return cls(df.limit(limit) if limit is not None else df)

    @classmethod
    def mapped(cls, spark: SparkSession, path: str, columns: dict[str, str], schema: str | None = None) -> Records:
        """From JSON lines or Parquet, with columns renamed {name: column of the source}; only those are read."""
        df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else readers.json_lines(spark, path, schema or ", ".join(f"{c} string" for c in columns.values()))
        return cls(df.select(*[F.col(c).alias(n) for n, c in columns.items()]))

    def filter(self, keep: Column | str | Callable[[dict], bool]) -> Records:
        """By an expression, which the optimiser sees, or by a function of a record."""
        if isinstance(keep, (Column, str)):
            return Records(self.df.where(keep))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf[[bool(keep(r)) for r in pdf.to_dict("records")]]

        return Records(self.df.mapInPandas(run, self.df.schema))

    def map(self, change: Callable[[dict], dict], schema: str | T.StructType | None = None) -> Records:
        """By a function from record to record; schema: of the results, unless it stays."""
        schema = schema or self.df.schema

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame([change(r) for r in pdf.to_dict("records")])

        return Records(self.df.mapInPandas(run, schema))

    def steps(self, *changes: Callable[[DataFrame], DataFrame]) -> Records:
        df = self.df
        for change in changes:
            df = df.transform(change)
        return Records(df)

    def shuffle(self, seed: int, key: str) -> Records:
        """In an order that depends on the seed and the key alone; 0 is a seed like any other."""
        return Records(self.df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key))

    def buffered_shuffle(self, seed: int, key: str, block: int) -> Records:
        """Shuffled within blocks of consecutive keys, so that only neighbours change places."""
        return Records(self.df.orderBy(F.floor(F.col(key) / block), F.xxhash64(F.lit(seed), F.col(key))))

    def split(self, ratio: float, seed: int, key: str) -> tuple[Records, Records]:
        """Training and held-out records, with exact counts."""
        df = hash_split(self.df, key, ratio, seed)
        return Records(df.where("not held").drop("held")), Records(df.where("held").drop("held"))

    def worker(self, index: Column, worker: int, workers: int) -> Records:
        return Records(readers.worker_slice(self.df, index, worker, workers))

    def repeat(self, epochs: int) -> Records:
        return Records(self.df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))))

    def union(self, *others: Records) -> Records:
        df = self.df
        for other in others:
            df = df.unionByName(other.df, allowMissingColumns=True)
        return Records(df)

    def save(self, path: str, form: str = "jsonl") -> None:
        if form == "jsonl":
            readers.write_json_lines(self.df, path)
        elif form == "parquet":
            self.df.write.mode("overwrite").parquet(path)
        else:
            raise ValueError(f"no writer for {form}")


def with_retry(call: Callable[[], Any], attempts: int = 5, wait: Callable[[float], None] = time.sleep) -> Any:
    """A call of the driver, tried again after min(2^n, 30) seconds, attempts times at most."""
    for n in range(attempts):
        try:
            return call()
        except OSError:
            if n == attempts - 1:
                raise
            wait(min(2**n, 30))
    raise ValueError("attempts must be positive")
