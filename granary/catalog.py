"""Every query of the library's own operators, collected from the modules that define them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from .session import guard

MODULES: tuple[str, ...] = (
    "granary.operators.corpus",
    "granary.operators.text",
    "granary.operators.relational",
    "granary.operators.chat",
    "granary.operators.routing",
    "granary.operators.series",
    "granary.operators.detection",
    "granary.sources.queries",
    "granary.sources.artifacts",
    "granary.streaming.queries",
)


def _guarded(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(guard(spark), sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        for key, query in import_module(name).QUERIES.items():
            assert key not in out, key
            out[key] = _guarded(query)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out |= import_module(name).ORACLES
    return out
