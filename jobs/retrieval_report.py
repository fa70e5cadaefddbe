"""How well retrievers find the evidence of questions (batch).

Each retriever searches all questions among all documents; hits are written by retriever, read again and judged, and
a report follows: each question's metrics, and their means with bootstrap intervals. Partitions of the retrievers that
a run is about are replaced, others stay, so runs of single retrievers add up and a run that is repeated changes
nothing."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findery.operators import judge, metrics, retrieve
from findery.session import bounded, spread

from . import settings

LOG = logging.getLogger("jobs.retrieval_report")
HITS = "query_id long, rank int, id long, score double"
REPORT = "kind string, query_id long, metric string, value double, retriever string"
RETRIEVERS = {"bm25": retrieve.bm25, "overlap": retrieve.overlap}
METRICS = ("recall@1", "recall@5", "mrr@10")
REPEATS = 200


def judged(hits: DataFrame, questions: DataFrame, documents: DataFrame) -> DataFrame:
    """hits with hit: whether the document has the question's evidence, as far as containment tells."""
    found = documents.select("id", "text").join(bounded(hits), "id").join(bounded(questions.select("query_id", "evidence")), "query_id")
    return found.select("query_id", "rank", "id", "score", judge.evidence_ok(F.col("evidence"), F.col("text"), None).alias("hit"))


def report(hits: DataFrame, questions: DataFrame, documents: DataFrame, names: Sequence[str], repeats: int, seed: int) -> DataFrame:
    """kind, query_id, metric, value: one row a question and metric (kind question), and of each metric the number of
    questions (n), the mean and its limits (mean, lo, hi; without questions n alone)."""
    values = metrics.metric_values(judged(hits, questions, documents), questions, list(names), "hit")
    each = values.select(F.lit("question").alias("kind"), "query_id", "metric", "value")
    listed = values.sparkSession.createDataFrame([(m,) for m in names], "metric string")
    whole = listed.join(metrics.summarize(values, ["metric"], None, repeats, seed=seed), "metric", "left")
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in (("n", F.coalesce("n", F.lit(0)).cast("double")), ("mean", F.round("mean", 6)), ("lo", F.round("lo", 6)), ("hi", F.round("hi", 6)))))
    told = whole.select("metric", F.explode(kinds).alias("k")).select("k.kind", F.lit(None).cast("long").alias("query_id"), "metric", "k.value")
    return each.unionByName(told.where("value is not null"))


def read(spark: SparkSession, output: str) -> DataFrame:
    """The whole output: the report, and the hits as rows of kind hit."""
    lines = spark.read.schema(REPORT).parquet(f"{output}/report")
    hits = spark.read.schema(f"{HITS}, retriever string").parquet(f"{output}/hits")
    hits = hits.select("retriever", F.lit("hit").alias("kind"), "query_id", F.col("score").alias("value"), "rank", "id")
    return lines.unionByName(hits, allowMissingColumns=True).select("retriever", "kind", "query_id", "metric", "rank", "id", "value")


def run(spark: SparkSession, documents: str, questions: str, output: str, retrievers: Sequence[str] = tuple(RETRIEVERS), names: Sequence[str] = METRICS, depth: int = 20, repeats: int = REPEATS, seed: int = 0) -> dict:
    """documents: Parquet with doc_id, text, source; questions: Parquet with item_id, text and maybe evidence (else the
    text is it). Gives the numbers of documents, questions and hits by retriever."""
    unknown = set(retrievers) - RETRIEVERS.keys()
    if unknown or max(metrics.parse(m)[1] for m in names) > depth:
        raise ValueError(f"unknown retrievers {sorted(unknown)}; or a metric looks deeper than {depth}")
    rows = spread(spark.read.parquet(documents)).select(F.col("doc_id").alias("id"), "source", "text")
    asked = spark.read.parquet(questions)
    asked = asked.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.col("evidence" if "evidence" in asked.columns else "text").alias("evidence"))
    told = {"documents": rows.count(), "questions": asked.count(), "hits": {}}
    LOG.info("read %s: %d documents; %s: %d questions", documents, told["documents"], questions, told["questions"])
    for name in retrievers:
        path = f"{output}/hits/retriever={name}"
        RETRIEVERS[name](asked.select("query_id", "query"), rows, depth).write.mode("overwrite").parquet(path)
        hits = spark.read.schema(HITS).parquet(path)
        lines = report(hits, asked, rows, names, repeats, seed).withColumn("retriever", F.lit(name))
        lines.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("retriever").parquet(f"{output}/report")
        told["hits"][name] = hits.count()
        LOG.info("wrote %s: %d hits; %s/report: the lines of %s", path, told["hits"][name], output, name)
    return told


if __name__ == "__main__":
    settings.main("retrieval_report", run)
