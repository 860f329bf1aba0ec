"""Streams: bounded buffers with an update trigger, running statistics by key, incremental histograms and event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, schema: str, per_trigger: int | None = None) -> DataFrame:
    """A Parquet folder as a stream."""
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def bounded_buffer(events: DataFrame, key: str, value: str, keep: int = 64, ready: int = 16) -> DataFrame:
    """(key, n, mean): an update whenever a key's buffer of its last `keep` values has `ready` ones; the buffer is cleared then."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        out = []
        for pdf in batches:
            for v in pdf[value].tolist():
                held = [*held, v][-keep:]
                if len(held) >= ready:
                    out.append((group[0], len(held), sum(held) / len(held)))
                    held = []
        state.update((held,))
        yield pd.DataFrame(out, columns=["key", "n", "mean"])

    return events.groupBy(key).applyInPandasWithState(step, "key long, n long, mean double", "held array<double>", "append", GroupStateTimeout.NoTimeout)


def running_mean(events: DataFrame, key: str, value: str, smoothing: float = 0.99) -> DataFrame:
    """(key, n, ewma) of each key after each trigger, from state that outlives it."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean = state.get if state.exists else (0, 0.0)
        for pdf in batches:
            for v in pdf[value].tolist():
                mean = v if n == 0 else smoothing * mean + (1 - smoothing) * v
                n += 1
        state.update((n, mean))
        yield pd.DataFrame([(group[0], n, mean)], columns=["key", "n", "ewma"])

    return events.groupBy(key).applyInPandasWithState(step, "key long, n long, ewma double", "n long, ewma double", "update", GroupStateTimeout.NoTimeout)


def histogram(events: DataFrame, value: str) -> DataFrame:
    """Counts by value; in complete mode the whole histogram after each trigger."""
    return events.groupBy(value).count()


def tumbling(events: DataFrame, ts: str, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums by event-time window and type, final once the watermark has passed."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def drain(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what there is into a memory table; for tests and batch use of a streaming plan."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
