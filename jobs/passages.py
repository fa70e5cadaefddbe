"""Passages of new documents (incremental).

A file stream takes the Parquet files below a folder that its checkpoint doesn't know yet, cleans their documents, packs
their lines into passages as the retrievers read them, and adds those that are not there yet to a table by source. A
passage is known by its id, a hash of source, part and text, so a document that comes again in another file adds
nothing. The ids that are known are the stream's state, which lies in the checkpoint; a run that is stopped is taken up
at its last batch, and files of a batch that didn't end don't count."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findery.operators import chunk, clean

from . import settings

LOG = logging.getLogger("jobs.passages")
DOCUMENTS = "text string, source string"
PASSAGES = "id string, text string, part int, n_tokens int, source string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WRITERS = 8  # tasks that may write one source in a batch, so that a hot source isn't one task


def passages(documents: DataFrame, max_words: int = chunk.MAX_TOKENS, overlap: int = chunk.OVERLAP_TOKENS, min_words: int = chunk.MIN_TOKENS) -> DataFrame:
    """documents (text, source) -> PASSAGES, each row by itself. Null texts have none; a null source is the empty one."""
    whole = clean.cleaned(F.col("text"), F.array().cast("array<string>"))
    rows = documents.select(F.coalesce("source", F.lit("")).alias("source"), chunk.line_paragraphs(whole, max_words).alias("text"), F.lit(1).alias("page"), F.array().cast("array<string>").alias("path"))
    packed = chunk.chunk_sections(rows, max_tokens=max_words, overlap=overlap, min_tokens=min_words)
    return packed.select("id", "text", "metadata.part", "n_tokens", "metadata.source")


def read(spark: SparkSession, output: str) -> DataFrame:
    """The table as it stands; empty where no run has written."""
    try:
        rows = spark.read.schema(PASSAGES).parquet(output)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], PASSAGES)
    return rows.withColumn("source", F.coalesce("source", F.lit("")))


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, max_words: int = chunk.MAX_TOKENS, overlap: int = chunk.OVERLAP_TOKENS, min_words: int = chunk.MIN_TOKENS, files_per_batch: int = 10_000) -> dict:
    """Adds the passages of the files below documents (a folder or a pattern) that are new since the last run with this
    checkpoint. Output and sizes belong to the checkpoint: other ones need a new one. Gives documents read and passages
    written by this run."""
    with settings.changed(spark, spark_sql_streaming_stateStore_providerClass=ROCKS):
        rows = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_per_batch).parquet(documents)
        new = passages(rows, max_words, overlap, min_words).dropDuplicates(["id"])
        dealt = new.repartition("source", F.pmod(F.xxhash64("id"), F.lit(WRITERS))).observe("written", F.count("*").alias("passages"))
        stream = dealt.writeStream.format("parquet").partitionBy("source").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(output)
        stream.awaitTermination()
    told = {"batches": 0, "documents": 0, "passages": 0}
    for progress in stream.recentProgress:
        written = progress.observedMetrics.get("written") if progress.numInputRows else None
        told["batches"] += progress.numInputRows > 0
        told["documents"] += progress.numInputRows
        told["passages"] += written["passages"] if written else 0
    LOG.info("read %s: %d new documents in %d batches", documents, told["documents"], told["batches"])
    LOG.info("wrote %s: %d new passages", output, told["passages"])
    return told


if __name__ == "__main__":
    settings.main("passages", run)
