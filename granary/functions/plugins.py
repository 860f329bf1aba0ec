"""Where user code comes in: reward functions, tokenisers, benchmarks, and a registry by name."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Tokenizer(Protocol):
    def encode(self, text: str) -> list[int]: ...

    def decode(self, ids: list[int]) -> str: ...


class Registry:
    """Names to objects; a name is taken once."""

    def __init__(self) -> None:
        self._held: dict[str, Any] = {}

    def register(self, name: str) -> Callable[[Any], Any]:
        def put(thing: Any) -> Any:
            if name in self._held:
                raise KeyError(f"{name} is taken")
            self._held[name] = thing
            return thing

        return put

    def get(self, name: str) -> Any:
        if name not in self._held:
            raise KeyError(f"{name} is none of {sorted(self._held)}")
        return self._held[name]

    def names(self) -> list[str]:
        return sorted(self._held)


REWARDS = Registry()


def reward_column(function: Callable[..., list[float]], completion: Column, *more: Column) -> Column:
    """A reward function of lists (completions, ...) as a column, called once for each Arrow batch."""

    @F.pandas_udf(T.DoubleType())
    def score(first: pd.Series, *rest: pd.Series) -> pd.Series:
        return pd.Series(function(first.tolist(), *[r.tolist() for r in rest]), dtype=float)

    return score(completion, *more)


def encode_column(tokenizer: Tokenizer, text: Column, bos: int | None = None, eos: int | None = None) -> Column:
    """Token ids by a tokeniser object, which is shipped once to each task."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: pd.Series) -> pd.Series:
        lead, tail = [bos] * (bos is not None), [eos] * (eos is not None)
        return pd.Series([None if t is None else [*lead, *tokenizer.encode(t), *tail] for t in texts])

    return encode(text)


def decode_column(tokenizer: Tokenizer, ids: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def decode(rows: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else tokenizer.decode([int(x) for x in r]) for r in rows])

    return decode(ids)


@F.udtf(returnType=T.StructType([T.StructField("window", T.LongType()), T.StructField("input_ids", T.ArrayType(T.IntegerType())), T.StructField("labels", T.ArrayType(T.IntegerType()))]))
class LmWindows:
    """A table function: windows of length + 1 ids every length ids; inputs without the last, labels without the first one."""

    def eval(self, ids: list[int], length: int) -> Iterator[tuple[int, list[int], list[int]]]:
        for w, at in enumerate(range(0, len(ids or []) - length, length)):
            yield w, ids[at : at + length], ids[at + 1 : at + length + 1]


def accumulate(rows: DataFrame, keys: list[str], update: Callable[[pd.DataFrame], dict], merge: Callable[[dict, dict], dict], schema: str) -> DataFrame:
    """A user's accumulator: update on each batch of a key's rows, merge of partial states, one row for each key."""
    import json

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, dict] = {}
        for pdf in batches:
            for key, part in pdf.groupby(keys, dropna=False):
                state = update(part)
                held[key] = merge(held[key], state) if key in held else state
        yield pd.DataFrame([(*key, json.dumps(state)) for key, state in held.items()], columns=[*keys, "state"])

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        states = [json.loads(s) for s in pdf["state"]]
        out = states[0]
        for s in states[1:]:
            out = merge(out, s)
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, **out}])

    named = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInPandas(partial, f"{named}, state string").groupBy(*keys).applyInPandas(final, schema)
