"""Mixing sources to target weights by Pareto order sampling (operator 8); DataFrame functions only.

Each document is to appear m times on average: m is its source's target over its source's size, tilted towards
short documents without changing the source's expected words. floor(m) whole copies are certain; the fraction left
is the document's inclusion probability p. Documents are ranked by random odds over inclusion odds,
(u / (1 - u)) / (p / (1 - p)), and taken in that order until the source has the words it lacks. The last document
taken may give its first words only, so each source meets its target to the word.

Ranks are never formed over a whole source: documents are counted into buckets of the rank, the bucket that holds
the end of the sample is found from those counts, and only its own documents are put in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MAX_TIMES = 3
BUCKETS = 4096
TILT = 0.5  # share of the room between 0 and MAX_TIMES that lengths may use
SHORT = 500  # words at which the tilt is half of its range
UNIT = 1 << 20
SEED = "mix-1"
HEX_DIGITS = 12


def source_targets(sources: DataFrame) -> DataFrame:
    """source, source_size -> the same with target: weights 1, 2, 3, repeating by code point with null last, share
    all sizes; none gets more than MAX_TIMES its size, the rest goes to the others by weight.

    In order of the size a unit of weight, those that meet their cap come first; the level of the others follows
    from the sums before the first that doesn't. Ranks and sums are formed over ranges of sources, which may be many;
    the driver gets two rows."""
    ranked = common.prefix_sums(sources.withColumn("__one", F.lit(1)), [], [F.col("source").asc_nulls_last()], {"__rank": "__one"})
    rows = ranked.withColumn("__w", F.col("__rank") % 3 + 1).withColumn("__cap", MAX_TIMES * F.col("source_size"))
    rows = rows.withColumn("__unit", F.col("__cap").cast("double") / F.col("__w"))
    rows = common.prefix_sums(rows, [], ["__unit", "__rank"], {"__caps": "__cap", "__ws": "__w"})
    rows = common.stage(rows, "mix-levels")
    size, weight = rows.agg(F.sum("source_size"), F.sum("__w")).first()
    left, share = (F.lit(size or 0) - F.col("__caps")).cast("double"), (F.lit(weight or 0) - F.col("__ws")).cast("double")
    cap, whole = F.col("__cap").cast("double"), F.col("__w").cast("double")
    first = rows.where(cap * share >= left * whole).agg(F.min(F.struct("__unit", "__rank", left.alias("left"), share.alias("share")))).first()[0]
    if first is None:  # no sources
        return rows.select(*sources.columns, cap.alias("target"))
    met = cap * first["share"] < F.lit(first["left"]) * whole
    return rows.select(*sources.columns, F.when(met, cap).otherwise(F.lit(first["left"]) * whole / first["share"]).alias("target"))


def uniform() -> Column:
    """In (0, 1), from doc_id alone: reruns agree, and equal ids tie."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{SEED}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, HEX_DIGITS)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**HEX_DIGITS)


def mix(rows: DataFrame) -> DataFrame:
    """rows (doc_id, source, size and any others) with source_size, target, taken.

    taken is in words, at most MAX_TIMES of size; a source of no words takes none. Null sources are one source.
    Rows that are equal in all of doc_id, source and size are interchangeable. Columns of these names are replaced, all
    others stay, whatever their names are. An empty table gives an empty one."""
    rows = rows.drop("source_size", "target", "taken")
    names, (rows, _) = rows.columns, common.shield(rows, ("doc_id", "source", "size"))
    lean = (F.lit(SHORT * UNIT).cast("long") / (SHORT + F.col("size"))).cast("long")  # whole: sums don't depend on order
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * lean).alias("__lean"))
    sources = common.stage(source_targets(sums), "mix-sources")
    times = F.col("target") / F.col("source_size")
    mean = F.col("__lean") / F.col("source_size")
    marked = common.join_params(rows, sources, "source")
    tilted = times + F.lit(TILT) * F.least(times, MAX_TIMES - times) * (lean - mean) / float(UNIT)
    marked = marked.withColumn("__m", F.when((F.col("size") > 0) & (F.col("target") > 0), F.least(F.lit(float(MAX_TIMES)), F.greatest(F.lit(0.0), tilted))).otherwise(0.0))
    marked = marked.withColumn("__sure", F.floor("__m").cast("long")).withColumn("__p", F.col("__m") - F.col("__sure"))
    high, low = uniform() * (1 - F.col("__p")), (1 - uniform()) * F.col("__p")
    marked = marked.withColumn("__v", F.when(F.col("__p") > 0, high / (high + low)))  # q / (1 + q) has the order of q
    marked = marked.withColumn("__b", F.least(F.lit(BUCKETS - 1), F.floor(F.col("__v") * BUCKETS)).cast("int"))

    counted = marked.groupBy("source", "__b").agg(F.sum(F.col("__sure") * F.col("size")).alias("__sure"), F.sum(F.when(F.col("__b").isNotNull(), F.col("size")).otherwise(0)).alias("__n"), F.max("target").alias("__t"))
    by_bucket = Window.partitionBy("source").orderBy(F.col("__b").asc_nulls_first())
    counted = counted.withColumn("__upto", F.sum("__n").over(by_bucket)).withColumn("__lack", F.floor(F.col("__t") + 0.5).cast("long") - F.sum("__sure").over(Window.partitionBy("source")))
    ends = counted.where((F.col("__b").isNotNull()) & (F.col("__upto") >= F.col("__lack")) & (F.col("__upto") - F.col("__n") < F.col("__lack")))
    ends = ends.select("source", F.col("__b").alias("__end"), (F.col("__lack") - F.col("__upto") + F.col("__n")).alias("__rest"))
    ended = common.join_params(marked, common.stage(ends, "mix-ends"), "source")

    given = [*rows.columns, "source_size", "target"]
    sure = F.col("__sure") * F.col("size")
    at_end = F.coalesce(F.col("__b") == F.col("__end"), F.lit(False))
    clear = ended.where(~at_end).select(*given, (sure + F.when(F.col("__b") < F.col("__end"), F.col("size")).otherwise(0)).alias("taken"))
    order = Window.partitionBy("source").orderBy("__v", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = ended.where(at_end).withColumn("__upto", F.sum("size").over(order))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("__rest") - F.col("__upto") + F.col("size")))
    out = clear.unionByName(edge.select(*given, (sure + part).alias("taken")))
    return out.select(*(F.col(c).alias(name) for c, name in zip(rows.columns, names, strict=True)), "source_size", "target", "taken")


def op8_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, source, size, source_size, target, taken."""
    docs = common.load(spark, sf_dir, "documents")
    sized = common.stage(docs.select("doc_id", "source", common.word_count(F.col("text")).alias("size")), "mix-sizes")
    return mix(sized)


SQL = rf"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
leaned AS (SELECT *, trunc({SHORT * UNIT} / ({SHORT} + size)::DOUBLE)::BIGINT AS lean FROM sized),
sums AS (SELECT source, sum(size)::BIGINT AS source_size, sum(size * lean)::BIGINT AS leans FROM leaned GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM sums),
weighed AS (SELECT *, ((k - 1) % 3 + 1)::DOUBLE AS w, ({MAX_TIMES} * source_size)::DOUBLE AS cap FROM ranked),
levels AS (SELECT *, sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER before, 0) AS lefts, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS shares FROM weighed
  WINDOW before AS (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
opened AS (SELECT lefts AS l, shares AS s FROM levels WHERE cap * shares >= lefts * w ORDER BY cap / w, k LIMIT 1),
targets AS (SELECT source, source_size, leans, CASE WHEN cap * s < l * w THEN cap ELSE l * w / s END AS target FROM levels, opened),
joined AS (SELECT a.*, t.source_size, t.target, t.target / t.source_size AS f, t.leans / t.source_size::DOUBLE AS mean,
  (('0x' || substr(md5('{SEED}|' || coalesce(a.doc_id::VARCHAR, 'null')), 1, {HEX_DIGITS}))::BIGINT::DOUBLE + 0.5) / {float(16**HEX_DIGITS)} AS u
  FROM leaned a JOIN targets t ON a.source IS NOT DISTINCT FROM t.source),
times AS (SELECT *, CASE WHEN size > 0 AND target > 0 THEN least({MAX_TIMES}.0::DOUBLE, greatest(0.0::DOUBLE, f + {TILT}::DOUBLE * least(f, {MAX_TIMES} - f) * (lean - mean) / {UNIT}.0::DOUBLE)) ELSE 0 END AS m FROM joined),
odds AS (SELECT *, floor(m)::BIGINT AS sure, m - floor(m) AS p FROM times),
keyed AS (SELECT *, CASE WHEN p > 0 THEN u * (1 - p) / (u * (1 - p) + (1 - u) * p) END AS v FROM odds),
summed AS (SELECT *, floor(target + 0.5)::BIGINT - sum(sure * size) OVER (PARTITION BY source) AS lack,
  sum(CASE WHEN v IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY v NULLS FIRST, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS upto FROM keyed)
SELECT doc_id, size, source_size, target, (sure * size + CASE WHEN v IS NULL THEN 0 ELSE greatest(0, least(size, lack - upto + size)) END)::BIGINT AS taken, source FROM summed
"""
