"""A question set from sections: which sections to ask about, which replies to keep, where to go on."""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as tx
from . import judge

MIN_WORDS, MAX_WORDS = 120, 3500
# Headings of sections that hold no explanations.
SKIP = (
    r"(?i)\b(references|bibliography|index|contents|preface|acknowledg\w*|about the authors?|homework|problems|exercises|"
    r"review questions|wireshark lab\w*|programming assignments?|interview|summary)\b"
)
PROMPT = """Write questions that a student might ask and that this one section of a book answers.

Section: {path}
{text}

Each question must be answerable from the section alone and make sense without it: no mention of the text, a figure or
an example, and no phrase copied from it. Label each one factual (a value, definition or behaviour), conceptual (why or
how) or keyword (about an exact term that is typed as it stands). Write one question for about 150 words, five at most;
none for exercises, references, contents and the like. For each question copy the one sentence, character by
character, that supports its answer best.

Reply with JSON only: {{"questions": [{{"query": "...", "type": "factual|conceptual|keyword", "evidence": "..."}}]}}"""

#: What a reply looks like, as a JSON schema for models that can be held to one.
FIELDS = {"query": {"type": "string"}, "type": {"enum": ["factual", "conceptual", "keyword"]}, "evidence": {"type": "string"}}
QUESTION = {"type": "object", "properties": FIELDS, "required": list(FIELDS)}
REPLY = {"type": "object", "properties": {"questions": {"type": "array", "items": QUESTION, "maxItems": 5}}, "required": ["questions"]}


def section_key() -> Column:
    return F.concat_ws("|", F.col("source"), F.col("page").cast("string"), F.array_join("path", " > "))


def eligible(sections: DataFrame, low: int = MIN_WORDS, high: int = MAX_WORDS) -> DataFrame:
    """Sections of a fitting number of white-space words without a heading to skip on their path; with n_words."""
    rows = sections.withColumn("n_words", tx.count_words(F.col("text")))
    return rows.where(F.col("n_words").between(low, high) & ~F.exists("path", lambda h: h.rlike(SKIP)))


def in_fixed_order(sections: DataFrame, limit: int, seed: int = 0, keys: tuple[str, ...] = ("doc", "section_no")) -> DataFrame:
    """The first sections in the order of a hash of their keys, with ask_order: a greater limit gives the same ones and
    more. Each task passes on so many rows at most, and only those are numbered."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys))
    first = sections.withColumn("__hash", F.md5(text)).orderBy("__hash", *keys).limit(limit)
    return first.withColumn("ask_order", F.row_number().over(Window.orderBy("__hash", *keys))).drop("__hash")


def shuffled(keys: list, seed: int = 0) -> list:
    """The order that Python's generator gives a list of keys, for parity with sets that were drawn that way."""
    out = list(keys)
    random.Random(seed).shuffle(out)
    return out


def todo(sections: DataFrame, progress: DataFrame) -> DataFrame:
    """Of the sections in their order, those whose key isn't in the progress table."""
    rows = sections.withColumn("key", section_key())
    return rows.join(progress.select("key").distinct(), "key", "left_anti")


def ask(sections: DataFrame, llm: Callable[[str], list[dict]], retries: int = 1) -> DataFrame:
    """key, source, path, page, text, questions, failed: a reply of the model for each section, in Python. A section
    that fails every time is marked and asked again by the next run."""
    rows = sections.select(section_key().alias("key"), "source", F.array_join("path", " > ").alias("section"), "page", "text")

    def run(batches):
        for part in batches:
            replies, failed = [], []
            for path, text in zip(part["section"], part["text"], strict=True):
                reply = None
                for _ in range(retries + 1):
                    try:
                        reply = [{k: None if q.get(k) is None else str(q.get(k)) for k in ("query", "type", "evidence")} for q in llm(PROMPT.format(path=path, text=text))]
                        break
                    except Exception:  # a reply that isn't JSON, or a server that is down: an error row, not an error
                        continue
                replies.append(reply or [])
                failed.append(reply is None)
            yield part.assign(questions=replies, failed=failed)

    return rows.mapInPandas(run, "key string, source string, section string, page int, text string, questions array<struct<query:string,type:string,evidence:string>>, failed boolean")


def reply_questions(replies: DataFrame) -> DataFrame:
    """Replies as rows: key, ordinal, query (single blanks), type, evidence, section_text, relevant."""
    rows = replies.where("NOT failed").select("key", "source", "section", "page", "text", F.posexplode("questions").alias("ordinal", "q"))
    label = F.array(F.struct("source", "section", "page"))
    return rows.select("key", "ordinal", tx.squeeze(F.coalesce("q.query", F.lit(""))).alias("query"), F.col("q.type").alias("type"), F.col("q.evidence").alias("evidence"), F.col("text").alias("section_text"), label.alias("relevant"))


def validate(rows: DataFrame, seen: DataFrame, order: list[str], threshold: float = judge.THRESHOLD, ascii_only: bool = False) -> DataFrame:
    """rows (query, type, evidence, section_text, and order) with reason: malformed, evidence not in section, duplicate
    or null for those to keep; the first that holds. seen has the queries that earlier runs kept.

    Of equal questions the first in the order stays; only questions that pass the other checks count."""
    kinds = F.coalesce(F.col("type").isin(*schemas.QUESTION_TYPES), F.lit(False))
    malformed = (F.coalesce("query", F.lit("")) == "") | ~kinds | F.col("evidence").isNull()
    found = judge.evidence_ok(F.col("evidence"), F.col("section_text"), threshold, ascii_only)
    first = rows.withColumn("reason", F.when(malformed, "malformed").when(~found, "evidence not in section"))
    first = first.withColumn("__norm", tx.comparable(F.col("query"), ascii_only))
    passed = first.where("reason IS NULL").withColumn("__k", F.row_number().over(Window.partitionBy("__norm").orderBy(*order)))
    old = seen.select(tx.comparable(F.col("query"), ascii_only).alias("__norm"), F.lit(True).alias("__old")).distinct()
    passed = passed.join(old, "__norm", "left").withColumn("reason", F.when((F.col("__k") > 1) | F.col("__old").isNotNull(), "duplicate"))
    return first.where("reason IS NOT NULL").select(*rows.columns, "reason").unionByName(passed.select(*rows.columns, "reason"))


def stats(replies: DataFrame, validated: DataFrame, already_done: int) -> DataFrame:
    """sections, kept, rejected, failed, already_done: one row."""
    asked = replies.agg(F.count(F.when(~F.col("failed"), 1)).alias("sections"), F.count(F.when(F.col("failed"), 1)).alias("failed"))
    checked = validated.agg(F.count(F.when(F.col("reason").isNull(), 1)).alias("kept"), F.count("reason").alias("rejected"))
    return asked.crossJoin(checked).select("sections", "kept", "rejected", "failed", F.lit(already_done).alias("already_done"))


def progress_rows(replies: DataFrame, validated: DataFrame) -> DataFrame:
    """key, kept, rejected for sections that were asked; to be written after the questions, so that a run that breaks
    off asks a section again instead of losing its questions."""
    counts = validated.groupBy("key").agg(F.count(F.when(F.col("reason").isNull(), 1)).cast("int").alias("kept"), F.count("reason").cast("int").alias("rejected"))
    none = F.lit(0)
    return replies.where("NOT failed").select("key").distinct().join(counts, "key", "left").select("key", F.coalesce("kept", none).alias("kept"), F.coalesce("rejected", none).alias("rejected"))


