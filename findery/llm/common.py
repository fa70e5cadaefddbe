"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import spread

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE_WORD = r"[^\x20\x09-\x0D]+"  # a run without ASCII white space
SPACE_GAP = r"[\x20\x09-\x0D]+"
PLAIN_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what separates lower-cased ASCII or any other words
ROWS_PER_SLICE = 512
ARROW_ROWS, ARROW_BYTES = 1000, 16 << 20  # of a batch that goes to Python
HOT_ROWS = 1000  # of one key, from which its rows are dealt out for a join
HOT_KEYS = 1000  # that a list may name
BROADCAST_ROWS = 200_000  # of two or three narrow columns: some tens of MB at most


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where there is none, a temporary one is set in a session that has no other
    machines, as in tests; a cluster must name one that all its machines share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="findery-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove_late(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session has gone already
        return


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: cuts the lineage, outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/findery/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove_late, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def stage_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """stage in buckets of a key, as many as a shuffle has partitions: joins on the key shuffle their other side only. df
    is dealt out by the key already, as an aggregate by it is; else each task writes a file a bucket."""
    spark, name = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/findery/{name}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).format("parquet").saveAsTable(name)
    atexit.register(_remove_late, spark, path)
    found = spark.read.table(name)
    spark.sql(f"DROP TABLE {name}")  # found has its files and buckets, the name isn't needed
    return found


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has been counted and has no more than so many rows, else df as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_params(big: DataFrame, params: DataFrame, on: str, rows: int = BROADCAST_ROWS, salts: int = 64) -> DataFrame:
    """Left join of rows with one row of parameters a key, null keys included.

    params is broadcast if counted to be small; beyond that each of its rows is copied to every salt, and the
    rows of big spread over the salts, so that a hot key isn't one task."""
    n = params.limit(rows + 1).count()
    right = params.withColumnRenamed(on, "__key")
    if n <= rows:
        return big.join(F.broadcast(right), F.col(on).eqNullSafe(F.col("__key")), "left").drop("__key")
    right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = big.withColumn("__row_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    cond = F.col(on).eqNullSafe(F.col("__key")) & (F.col("__row_salt") == F.col("__salt"))
    return left.join(right, cond, "left").drop("__key", "__salt", "__row_salt")


def join_hot(big: DataFrame, params: DataFrame, on: str, n: str, hot: int = HOT_ROWS, keys: int = HOT_KEYS, salts: int = 64) -> DataFrame:
    """Inner join of rows with parameters of keys, of which n says how many rows of big have the key (or more).

    Rows of keys with more than hot of them are joined apart, so that no task gets them all: up to so many keys are
    told by a list, more by a join. Their parameters are broadcast if counted to be few, else copied to salts. Keys
    aren't null."""
    many = params.where(F.col(n) > hot)
    listed = [r[0] for r in many.select(on).distinct().limit(keys + 1).collect()]
    cold = params.where(F.col(n) <= hot)
    if not listed:
        return big.join(cold, on)
    if len(listed) <= keys:
        is_hot = F.col(on).isin(listed)
    else:
        big = join_params(big, many.select(on).distinct().withColumn("__is_hot", F.lit(True)), on, salts=salts)
        is_hot = F.col("__is_hot").isNotNull()
    warm = big.where(is_hot)
    if many.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        warm = warm.join(F.broadcast(many), on)
    else:
        dealt = many.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salt = F.pmod(F.xxhash64(*warm.columns), F.lit(salts)).cast("int")
        warm = warm.withColumn("__salt", salt).join(dealt, [on, "__salt"]).drop("__salt")
    return big.where(~is_hot).join(cold, on).unionByName(warm).drop("__is_hot")


def prefix_sums(df: DataFrame, group: list[str], order: list[str | Column], values: dict[str, str]) -> DataFrame:
    """df with, for each name in values, the sum of its column over the rows of the group that come before in the order.

    Rows are dealt out by ranges of (group, order) and written, then summed inside a range of a group; a second
    window has one row for each range of a group. No group is one task."""
    part = free_name(df, "part")
    ranged = df.repartitionByRange(*group, *order).withColumn(part, F.spark_partition_id())
    ranged = stage(ranged, "ranges")
    before = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*group, part).orderBy(*order).rowsBetween(*before)
    whole = Window.partitionBy(*group).orderBy(part).rowsBetween(*before)
    sums = ranged.groupBy(*group, part).agg(*(F.sum(c).alias(f"__sum_{out}") for out, c in values.items()))
    earlier = [F.coalesce(F.sum(f"__sum_{out}").over(whole), F.lit(0)).alias(f"__before_{out}") for out in values]
    sums = sums.select(*(F.col(c).alias(f"__{c}") for c in group), F.col(part).alias("__part"), *earlier)
    same = F.col(part) == F.col("__part")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    summed = ranged.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"__in_{out}") for out, c in values.items()))
    joined = summed.join(sums, same)
    return joined.select(*df.columns, *((F.col(f"__in_{out}") + F.col(f"__before_{out}")).alias(out) for out in values))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def word_list(text: Column, gap: str = SPACE_GAP) -> Column:
    """The words between the gaps; null gives an empty array."""
    parts = F.split(F.coalesce(text, F.lit("")), gap)
    lead, trail = _empty_ends(parts)
    return F.slice(parts, lead + 1, F.size(parts) - lead - trail)


def word_count(text: Column, gap: str = SPACE_GAP) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), gap)
    lead, trail = _empty_ends(parts)
    return (F.size(parts) - lead - trail).cast("long")


def _empty_ends(parts: Column) -> tuple[Column, Column]:
    lead = (F.element_at(parts, 1) == "").cast("int")
    return lead, ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")


def free_name(df: DataFrame, name: str) -> str:
    """name, or with underscores before it until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def small_batches(spark: SparkSession) -> None:
    """From now on, batches for Python are bounded by rows and bytes: several are in memory for each task at a time."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shield(df: DataFrame, used: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with all columns but the used ones under names that no operator has, and a function that gives the columns of
    df back, in their order and under their names."""
    names = {c: c if c in used else f"carried_{i}_" for i, c in enumerate(df.columns)}
    covered = df.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    return covered, lambda out: out.select(*(F.col(n).alias(c) for c, n in names.items()))


def map_columns(df: DataFrame, inputs: list[str], make: Callable[[], Callable[..., list[list]]], adds: str) -> DataFrame:
    """df with the columns that a Python function adds, in Arrow batches.

    make() runs once a task and gives a function from lists (one an input column) to lists (one an added column).
    Added columns replace those of the same name. Batches are cut to ROWS_PER_SLICE rows, which bounds memory."""
    added = T._parse_datatype_string(adds) if isinstance(adds, str) else adds
    small_batches(df.sparkSession)
    names = {f.name.lower() for f in added.fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    schema = T.StructType([*kept, *added.fields])
    arrow_added = to_arrow_schema(added)
    kept_names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_PER_SLICE):
                batch = whole.slice(at, ROWS_PER_SLICE)
                made = step(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in inputs))
                arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept_names]
                fields = [batch.schema.field(c) for c in kept_names]
                arrays += [pa.array(values, type=f.type) for values, f in zip(made, arrow_added, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema([*fields, *arrow_added]))

    return df.mapInArrow(run, schema)
