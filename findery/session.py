"""Session settings that the engine is written for."""

from __future__ import annotations

import atexit
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
PACKED = "zstd"  # codec of tables that are written

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "findery", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """A table as it is read, dealt out to all cores where its files are too few to occupy them. A large table has more
    parts than there are cores and isn't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def temporary(spark: SparkSession, name: str) -> str:
    """A new path that all executors see: below spark.checkpoint.dir, or, in a session without other machines, the
    warehouse. A cluster must name the folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/findery/{name}-{uuid.uuid4().hex}"


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Inside, the files that a step has shuffled go as soon as it has ended, not when the driver next collects garbage."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """df as a table that is written now: what is read more than once is computed once, and outlives executors."""
    spark, path = df.sparkSession, temporary(df.sparkSession, name)
    with freeing(spark):
        df.write.option("compression", PACKED).parquet(path)
    if own := getattr(_scratch, "open", []):
        own[-1].append((spark, path))
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


_scratch = threading.local()


@contextmanager
def scratch() -> Iterator[list[tuple[SparkSession, str]]]:
    """Tables that this thread stages inside go at its end, but for those that are taken out of the list."""
    _scratch.open = [*getattr(_scratch, "open", []), []]
    try:
        yield _scratch.open[-1]
    finally:
        for spark, path in _scratch.open.pop():
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has gone already
        return


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count of at most rows + 1 rows shows that it is small, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def settled(df: DataFrame, name: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """bounded() for what is dear to compute: it is written first, so that the count doesn't compute it once more."""
    return bounded(stage(df, name), rows)
