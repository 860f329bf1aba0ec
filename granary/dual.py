"""Queries whose Spark SQL and DuckDB twin are one text, with a few words that each dialect spells in its own way."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

def spark_text(sql: str) -> str:
    """SHA(x) and STR as Spark spells them."""
    sql = re.sub(r"SHA\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)", r"sha2(\1, 256)", sql)
    return re.sub(r"\bSTR\b", "STRING", sql)


def duck_text(sql: str) -> str:
    """SHA(x), STR and {table} as DuckDB spells them."""
    sql = re.sub(r"\{(\w+)\}", r"\1", sql)
    return re.sub(r"\bSTR\b", "VARCHAR", sql.replace("SHA(", "sha256("))


def spark_query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query over the tables that the text names in braces."""
    names = sorted(set(re.findall(r"\{(\w+)\}", sql)))
    text = spark_text(sql)
    return lambda spark, sf_dir: spark.sql(text, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


class Book:
    """Queries and twins of a module."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def both(self, name: str, sql: str) -> None:
        self.queries[name], self.oracles[name] = spark_query(sql), duck_text(sql)

    def add(self, name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
        self.queries[name] = query
        if sql:
            self.oracles[name] = duck_text(sql)
