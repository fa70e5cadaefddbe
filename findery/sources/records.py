"""JSON Lines of chunks, questions and results, and a cache of sections."""

from __future__ import annotations

import hashlib
import inspect
import json
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def read(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Rows of a file, folder or list of them; blank lines are none, a path that isn't there is an empty table."""
    paths = [p for p in ([path] if isinstance(path, str) else path) if "*" in p or exists(spark, p)]
    return spark.read.schema(schema).json(paths) if paths else spark.createDataFrame([], schema)


def write(df: DataFrame, path: str, append: bool = False, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append" if append else "overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)


def read_chunks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read(spark, path, schemas.CHUNKS)


def read_questions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Questions with query_id, in the order of their lines; what is absent is empty."""
    from pyspark.sql import Window

    rows = read(spark, path, schemas.QUESTIONS).withColumn("__at", F.monotonically_increasing_id())
    empty = F.array().cast(f"array<{schemas.LABEL}>")
    number = F.row_number().over(Window.orderBy("__at")) - 1
    return rows.select(number.cast("long").alias("query_id"), "query", F.coalesce("type", F.lit("")).alias("type"), F.coalesce("evidence", F.lit("")).alias("evidence"), F.coalesce("relevant", empty).alias("relevant"))


def _any(spark: SparkSession, path: str | list[str]) -> bool:
    return any("*" in p or exists(spark, p) for p in ([path] if isinstance(path, str) else path))


def read_results(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Saved results with retriever, the name of their file or folder without its ending."""
    rows = read(spark, path, schemas.RESULTS)
    if not _any(spark, path):
        return rows.withColumn("retriever", F.lit(""))
    named = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.jsonl)?(/part-[^/]*)?$", 1)
    return rows.select("*", named.alias("retriever"))


def results_depth(results: DataFrame) -> int:
    """The least depth that was asked for; for rows without one, the longest list of hits."""
    found = results.agg(F.min("depth"), F.max(F.size(F.get(F.map_values("hits"), F.lit(0))))).first()
    return int(found[0] if found[0] is not None else found[1] or 0)


def exploded(results: DataFrame) -> DataFrame:
    """Results as judged hits: retriever, query, type, group, rank, score, hit_evidence, hit_section."""
    each = F.posexplode(F.arrays_zip(F.col("scores"), F.col("hits")["evidence"].alias("e"), F.col("hits")["section"].alias("s")))
    rows = results.select("retriever", "query", "type", "group", each.alias("k", "h"))
    return rows.select("retriever", "query", "type", "group", (F.col("k") + 1).alias("rank"), F.col("h.scores").alias("score"), F.col("h.e").alias("hit_evidence"), F.col("h.s").alias("hit_section"))


def code_version(*modules: ModuleType) -> str:
    """A hash of the modules' source texts, in their order: another one as soon as their code changes."""
    return hashlib.sha256("\0".join(inspect.getsource(m) for m in modules).encode()).hexdigest()[:16]


def cached_sections(spark: SparkSession, path: str, cache: str, make, version: str) -> DataFrame:
    """Sections of a file as a table under cache, made anew when the file's time or length or version differ."""
    fs, where = _fs(spark, path)
    status = fs.getFileStatus(where)
    key = json.dumps({"time": status.getModificationTime(), "length": status.getLen(), "version": version}, sort_keys=True)
    cfs, marker = _fs(spark, f"{cache}/key")
    if not (cfs.exists(marker) and spark.read.text(f"{cache}/key").first()[0] == key):
        make(spark, path).write.mode("overwrite").parquet(f"{cache}/sections")
        spark.createDataFrame([(key,)], "value string").coalesce(1).write.mode("overwrite").text(f"{cache}/key")
    return spark.read.parquet(f"{cache}/sections")
