"""Chat formatting by multi-party perspective rotation (operator 9); DataFrame functions only.

A dialogue is rendered once for every participant: that speaker is the assistant, the others are users with their
names, and system turns stay system turns. Only what the assistant says, with the mark that ends a turn, is to be
learned. A rendering is a table of its turns with their places in the whole rendering, in code points, so that a
dialogue is never one row. Places are sums inside ranges of turns and sums of ranges, so that a dialogue isn't one
task either; turns of a dialogue with very many are dealt out to meet its participants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
UNNAMED = "unknown"
CONTEXT = "system"
#: What ends or bends a line; a name stands in the first line of a turn.
BREAKS = "\n\r\v\f\x85\u2028\u2029"


def safe(text: Column) -> Column:
    """Marks of the format inside a text are broken up, so that no text opens or closes a turn."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def rotate(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) -> conv_id, perspective, turn, role, name, rendered, start, mask_start,
    mask_end; both masks are null for turns that aren't learned.

    Participants are the distinct roles but system; a null role is the participant unknown. A null text is empty.
    Turns are in the order of turn, role and text, nulls first; equal rows are turns of their own. Rows of a null
    conv_id are one dialogue. A dialogue of system turns only has no rendering. Line breaks in names are blanks. Other
    columns are left out."""
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("__key")  # one kind of key for null ids too
    rows = turns.select(key, "conv_id", "turn", F.coalesce("role", F.lit(UNNAMED)).alias("speaker"), safe(F.col("text")).alias("said"))
    counts = rows.groupBy("__key", "speaker").agg(F.count("*").alias("n"))
    people = counts.where(F.col("speaker") != CONTEXT).select("__key", F.col("speaker").alias("perspective"))
    people = common.stage(people.join(counts.groupBy("__key").agg(F.sum("n").alias("__turns")), "__key"), "participants")
    both = common.join_hot(rows, people, "__key", "__turns")
    mine = F.col("speaker") == F.col("perspective")
    role = F.when(mine, "assistant").when(F.col("speaker") == CONTEXT, CONTEXT).otherwise("user")
    name = F.when(~mine & (F.col("speaker") != CONTEXT), safe(F.translate("speaker", BREAKS, " " * len(BREAKS))))
    head = F.concat(F.lit(OPEN), role, F.coalesce(F.concat(F.lit(" name="), name), F.lit("")), F.lit("\n"))
    both = both.select("__key", "conv_id", "perspective", "turn", "speaker", "said", role.alias("role"), name.alias("name"), head.alias("__head"))
    both = both.withColumn("rendered", F.concat("__head", "said", F.lit(CLOSE))).withColumn("__n", F.length("rendered").cast("long")).withColumn("__head", F.length("__head").cast("long"))
    placed = common.prefix_sums(both, ["__key", "perspective"], ["turn", "speaker", "said"], {"start": "__n"})
    learned = lambda c: F.when(F.col("role") == "assistant", c)
    return placed.select("conv_id", "perspective", "turn", "role", "name", "rendered", "start", learned(F.col("start") + F.col("__head")).alias("mask_start"), learned(F.col("start") + F.col("__n")).alias("mask_end"))


def op9_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, one row a turn and participant."""
    return rotate(common.load(spark, sf_dir, "conversations"))


SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '{UNNAMED}') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS said FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> '{CONTEXT}'),
b AS (SELECT t.*, p.perspective, CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = '{CONTEXT}' THEN '{CONTEXT}' ELSE 'user' END AS role,
  CASE WHEN speaker <> perspective AND speaker <> '{CONTEXT}' THEN replace(translate(speaker, '{BREAKS}', '{" " * len(BREAKS)}'), '<|', '< |') END AS name FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, '{OPEN}' || role || coalesce(' name=' || name, '') || chr(10) AS head FROM b),
r AS (SELECT *, head || said || '{CLOSE.strip()}' || chr(10) AS rendered FROM h),
s AS (SELECT *, coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, said ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM r)
SELECT conv_id, perspective, turn, role, name, rendered, start, CASE WHEN role = 'assistant' THEN start + length(head) END AS mask_start, CASE WHEN role = 'assistant' THEN start + length(rendered) END AS mask_end FROM s
"""
