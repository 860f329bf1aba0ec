"""Session factory used by tests, the bench and interactive work; on a cluster the given session is used as it is."""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def guard(spark: SparkSession) -> SparkSession:
    """Settings without which some plans give wrong rows, for sessions that others made.

    Spark 4.1 lets a union report its children's partitioning; adaptive execution may then coalesce the children differently,
    and an aggregation above the union, planned without an exchange, sees only part of a key's rows.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


_ROOTS: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the cluster shares, removed when the driver ends; a local one only on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file:///tmp/granary-checkpoints"
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        _ROOTS[app] = f"{base.rstrip('/')}/granary-tables-{app}"
        atexit.register(release, spark)
    return f"{_ROOTS[app]}/{name}-{uuid.uuid4().hex[:12]}"


def release(spark: SparkSession) -> None:
    """Delete the session's scratch tables; results that still read them are void then."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(_ROOTS.pop(spark.sparkContext.applicationId))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # nothing was written, or the session and its JVM are gone
        pass


def materialised(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: computed once, whatever number of plans use it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def session(app: str = "granary", cores: int | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and as many shuffle partitions as cores unless told otherwise."""
    cores = cores or os.cpu_count() or 4
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("GRANARY_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return guard(spark)
