"""A corpus from raw documents: quality, near duplicates, decontamination, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again as the next
one's docs; all but the last keep the columns of docs. The last one adds size, source_size, target and taken."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findery.llm import common, decontaminate, jaccard, mixing, pii, quality

#: Columns that the stages look at; any others are carried along as they are.
USED = ("doc_id", "text", "lang", "source")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the distribution rules reject go."""
    rows, back = common.shield(docs, USED)
    return back(quality.assess(rows, quality.references(rows)).where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one document stays: that with the least doc_id (nulls last), then the least text_id;
    of rows with the same doc_id and text, one. Documents without words or near copies stay."""
    rows, back = common.shield(docs, USED)
    classes = jaccard.near_duplicates(rows).where(F.col("label").isNotNull() & F.col("class_id").eqNullSafe(F.col("doc_id")))
    firsts = classes.groupBy("label").agg(F.first("class_id").alias("__id"), F.min("text_id").alias("__text")).drop("label")
    keyed = rows.withColumn("text_key", F.unhex(F.md5("text")))
    kept = keyed.join(firsts, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("text_key").eqNullSafe(F.col("__text")), "left_semi")
    wordless = keyed.where(~F.coalesce(F.col("text"), F.lit("")).rlike(common.SPACE_WORD))
    return back(kept.dropDuplicates(["doc_id", "text_key"]).unionByName(wordless))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    rows, back = common.shield(docs, USED)
    return back(decontaminate.clean(rows, common.load(spark, sf_dir, "benchmark")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kinds; n_chars follows where a text changed."""
    rows, back = common.shield(docs, (*USED, "n_chars"))
    masked = pii.mask_pii(rows.withColumn("text_before", F.md5("text")))
    if "n_chars" in docs.columns:
        same = F.col("text_before").eqNullSafe(F.md5("text"))
        masked = masked.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return back(masked)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the words that it takes of each."""
    return mixing.mix(docs.withColumn("size", common.word_count(F.col("text")))).where("taken > 0")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("mixing sources to target weights", mixing_weights),
]

#: The stages on quality and personal data have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = common.stage(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
