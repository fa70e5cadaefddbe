"""From questions and retrievers to tables of metrics and confidence models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import calibrate, judge, metrics
from ..operators.retrieve import Retriever

KS, MRR_K, PRIMARY_K = (1, 5, 10, 20), 10, 5


@dataclass
class Report:
    """summary: retriever, metric, n, mean, lo, hi, cell; by_type: retriever, type, the same; comparison: retriever
    (against the first), metric, diff, lo, hi, p, verdict."""

    mode: str
    summary: DataFrame
    by_type: DataFrame
    comparison: DataFrame | None


def depth_of(ks=KS, mrr_k: int = MRR_K, primary_k: int = PRIMARY_K) -> int:
    return max(*ks, mrr_k, primary_k)


def judge_all(questions: DataFrame, chunks: DataFrame, retrievers: dict[str, Retriever], depth: int, threshold: float = judge.THRESHOLD) -> dict[str, DataFrame]:
    """Judged hits of every retriever. Questions must be about a source that the chunks have."""
    if not judge.shares_source(questions, chunks):
        raise ValueError("the questions are about other sources than the chunks; ingest the same book first")
    rows = chunks.withColumn("source", F.col("metadata.source"))
    asked = questions.select("query_id", "query")
    return {name: judge.judge(find(asked, rows, depth), questions, chunks, threshold) for name, find in retrievers.items()}


def report(judged: dict[str, DataFrame], questions: DataFrame, mode: str, ks=KS, mrr_k: int = MRR_K, primary_k: int = PRIMARY_K, by_section: bool = True, repeats: int = metrics.REPEATS, seed: int = 0) -> Report:
    """judged by retriever, the first of which the others are compared with; questions: query_id, type, group."""
    hit = f"hit_{judge.check_mode(mode)}"
    names = [f"recall@{k}" for k in ks] + [f"mrr@{mrr_k}"]
    primary = f"recall@{primary_k}"
    group = "group" if by_section else None
    values = None
    for name, rows in judged.items():
        own = metrics.metric_values(rows, questions, sorted({*names, primary}), hit, ("type", "group")).withColumn("retriever", F.lit(name))
        values = own if values is None else values.unionByName(own)
    cell = metrics.cell(F.col("mean"), F.col("lo"), F.col("hi")).alias("cell")
    summary = metrics.summarize(values.where(F.col("metric").isin(*names)), ["retriever", "metric"], group, repeats, seed=seed).select("*", cell)
    by_type = metrics.summarize(values.where(F.col("metric") == primary), ["retriever", "type"], group, repeats, seed=seed).select("*", cell)
    first, *others = judged
    if not others:
        return Report(mode, summary, by_type, None)
    main = values.where(F.col("metric") == primary)
    ref = main.where(F.col("retriever") == first).drop("retriever", "type", "group")
    both = ref.crossJoin(F.broadcast(values.sparkSession.createDataFrame([(o,) for o in others], "retriever string")))
    compared = metrics.paired(main.where(F.col("retriever") != first), both, ["retriever", "metric"], group, repeats, seed=seed)
    return Report(mode, summary, by_type, compared.withColumn("verdict", metrics.verdict(F.col("p"))))


def confidence(judged: DataFrame, questions: DataFrame, retriever: str, k: int = PRIMARY_K, mode: str = "evidence", seed: int = 0) -> calibrate.ConfidenceModel:
    hit = f"hit_{judge.check_mode(mode)}"
    success = judged.where(F.col("rank") <= k).groupBy("query_id").agg(F.max(hit).alias("__y"))
    rows = calibrate.hit_signals(judged, questions, k).join(questions.select("query_id", "group"), "query_id").join(success, "query_id", "left")
    return calibrate.fit(rows.withColumn("y", F.coalesce("__y", F.lit(False))).drop("__y"), retriever, k, mode, seed=seed)
