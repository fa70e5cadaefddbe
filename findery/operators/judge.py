"""Relevance of hits: by the evidence of a question, or by the section it was asked about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..functions import text as tx
from ..session import bounded, settled

MIN_EVIDENCE = 20
THRESHOLD = 90.0


def evidence_ok(evidence: Column, text: Column, threshold: float | None = THRESHOLD, ascii_only: bool = False) -> Column:
    """Whether the evidence, normalised and of 20 characters or more, nearly occurs in the text (or the text in it).

    What is contained is decided by expressions; only the rest is compared in Python, and without a threshold nothing
    is. Never null."""
    a, b = tx.comparable(evidence, ascii_only), tx.comparable(text, ascii_only)
    long = F.coalesce(F.length(a) >= MIN_EVIDENCE, F.lit(False)) & b.isNotNull()
    inside = long & (F.contains(b, a) | ((b != "") & F.contains(a, b)))
    if threshold is None:
        return inside
    rest = long & ~inside & (b != "")
    near = fuzzy.ratio_column(F.when(rest, a), F.when(rest, b), threshold) >= threshold
    return inside | F.coalesce(near, F.lit(False))


def section_ok(source: Column, section: Column, relevant: Column) -> Column:
    """Whether the chunk is from a labelled section or from one below it."""
    label = lambda r: F.coalesce(r["section"], F.lit(""))
    mine = F.coalesce(section, F.lit(""))
    return F.coalesce(F.exists(relevant, lambda r: (r["source"] == source) & ((mine == label(r)) | F.startswith(mine, F.concat(label(r), F.lit(" > "))))), F.lit(False))


def check_mode(mode: str) -> str:
    if mode not in ("evidence", "section"):
        raise ValueError(f"unknown mode {mode!r}; there are evidence and section")
    return mode


def group_key(relevant: Column) -> Column:
    """source|section of the first label; both empty without labels."""
    first = F.get(relevant, F.lit(0))
    return F.concat(F.coalesce(first["source"], F.lit("")), F.lit("|"), F.coalesce(first["section"], F.lit("")))


def judge(hits: DataFrame, questions: DataFrame, chunks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """hits (query_id, rank, id, score) -> with hit_evidence and hit_section.

    questions: query_id, evidence, relevant; chunks: id, text, metadata. Hits are few beside chunks, so they are
    broadcast to them if they are counted to be few."""
    rows = chunks.select("id", "text", "metadata").join(settled(hits, "hits"), "id").join(bounded(questions.select("query_id", "evidence", "relevant")), "query_id")
    return rows.select("query_id", "rank", "id", "score", evidence_ok(F.col("evidence"), F.col("text"), threshold).alias("hit_evidence"), section_ok(F.col("metadata.source"), F.col("metadata.section"), F.col("relevant")).alias("hit_section"))


def results(judged: DataFrame, questions: DataFrame, chunks: DataFrame, depth: int) -> DataFrame:
    """One row a question in the form in which results are saved; questions without hits have empty lists."""
    rows = judged.join(chunks.select("id", "metadata"), "id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score", "hit_evidence", "hit_section", "metadata"))).alias("h"))
    whole = questions.join(rows, "query_id", "left")
    hits = F.coalesce("h", F.array().cast(rows.schema["h"].dataType))
    each = lambda f: F.transform(hits, f)
    first = lambda c: F.array_min(F.transform(F.filter(hits, lambda h: h[c]), lambda h: h["rank"]))
    return whole.select(
        "query_id", "query", "type", group_key(F.col("relevant")).alias("group"), each(lambda h: h["score"]).alias("scores"),
        F.create_map(F.lit("evidence"), each(lambda h: h["hit_evidence"]), F.lit("section"), each(lambda h: h["hit_section"])).alias("hits"),
        each(lambda h: F.struct(h["id"].cast("string").alias("id"), h["metadata"]["source"].alias("source"), h["metadata"]["section"].alias("section"), h["metadata"]["page"].alias("page"), h["metadata"]["part"].alias("part"))).alias("retrieved"),
        F.create_map(F.lit("evidence"), first("hit_evidence"), F.lit("section"), first("hit_section")).alias("first_hit"), F.lit(depth).alias("depth"),
    )


def shares_source(questions: DataFrame, chunks: DataFrame) -> bool:
    """Whether any label is about a source that the chunks have."""
    labels = questions.select(F.explode("relevant.source").alias("source")).distinct()
    return not labels.join(chunks.select("metadata.source").distinct(), "source", "left_semi").isEmpty()
