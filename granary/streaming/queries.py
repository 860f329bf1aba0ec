"""Registered streaming queries: they run over the events table as a stream and return what the sink holds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dual import Book
from ..session import scratch
from . import monitor

BOOK = Book()


def _run(spark: SparkSession, sf_dir: str, make, mode: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return monitor.drain(make(events), f"stream_{uuid.uuid4().hex[:10]}", mode, scratch(spark, "stream"))


BOOK.add("stm08_streaming_histogram", lambda s, d: _run(s, d, lambda e: monitor.histogram(e, "event_type"), "complete"), "SELECT event_type, count(*) AS count FROM events GROUP BY event_type")
BOOK.add("stm01_bounded_buffer", lambda s, d: _run(s, d, lambda e: monitor.bounded_buffer(e, "user_id", "value", 64, 4), "append"))
BOOK.add("stm04_streaming_ewma", lambda s, d: _run(s, d, lambda e: monitor.running_mean(e, "user_id", "value"), "update"))
BOOK.add("ext_streaming_windows", lambda s, d: _run(s, d, lambda e: monitor.tumbling(e.withColumn("ts", F.col("ts").cast("timestamp")), "ts").select(F.col("window.start").alias("day"), "event_type", "n"), "append"))

QUERIES, ORACLES = BOOK.queries, BOOK.oracles
