"""DuckDB fragments shared by the SQL twins of the queries."""

from __future__ import annotations

from .functions import text as T

W, S = T.WORD, T.SPACE


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def replace(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {quoted(pattern)}, {quoted(by)}, 'g')"


def strip(x: str) -> str:
    return replace(x, rf"^[{S}]+|[{S}]+$", "")


def split(x: str, pattern: str = rf"[{S}]+") -> str:
    return f"list_filter(regexp_split_to_array({x}, {quoted(pattern)}), lambda w: w <> '')"


def clean(x: str, min_length: int = 10) -> str:
    for pattern in (T.HTML, T.URL, T.EMAIL):
        x = replace(x, pattern, " ")
    x = f"lower({strip(replace(x, rf'[{S}]+', ' '))})"
    return f"(CASE WHEN length({x}) >= {min_length} THEN {x} END)"


def plain_tokens(x: str) -> str:
    return split(f"lower({x})")


def metric_tokens(x: str) -> str:
    return split(replace(f"lower({x})", rf"[^{W}{S}]", ""))


def ngrams(t: str, n: int) -> str:
    return f"[array_to_string({t}[i:i+{n - 1}], ' ') FOR i IN range(1, len({t}) - {n} + 2)]"


def read(name: str):
    """A query callable's table reader."""

    def table(spark, sf_dir):
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    return table
