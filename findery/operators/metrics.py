"""Ranking metrics of judged hits, and bootstrap intervals of their means."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALPHA = 0.05
REPEATS = 2000


def parse(metric: str) -> tuple[str, int]:
    found = re.fullmatch(r"(recall|mrr)@([1-9]\d*)", metric)
    if not found:
        raise ValueError(f"unknown metric {metric!r}; there are recall@K and mrr@K")
    return found[1], int(found[2])


def first_hit(hit: Column) -> Column:
    """Aggregate: the least rank of a hit, null if there is none."""
    return F.min(F.when(hit, F.col("rank")))


def value(metric: str, first: Column) -> Column:
    """Of a question, from the rank of its first hit, null if there is none."""
    name, k = parse(metric)
    inside = F.coalesce(first <= k, F.lit(False))
    return F.when(inside, 1.0 if name == "recall" else 1 / first).otherwise(0.0)


def metric_values(judged: DataFrame, questions: DataFrame, metrics: list[str], hit: str = "hit", keep: tuple[str, ...] = ()) -> DataFrame:
    """query_id, metric, value (and keep, columns of questions) for every question, those without hits too."""
    firsts = judged.groupBy("query_id").agg(first_hit(F.col(hit)).alias("first"))
    rows = questions.select("query_id", *keep).join(firsts, "query_id", "left")
    each = F.array(*(F.struct(F.lit(m).alias("metric"), value(m, F.col("first")).alias("value")) for m in metrics))
    return rows.select("query_id", *keep, F.explode(each).alias("m")).select("query_id", *keep, "m.metric", "m.value")


def draw(seed: int, replicate: Column, slot: Column, n: Column) -> Column:
    """A group of n for a slot of a resample, by a hash: the same on every engine and in every run."""
    text = F.concat_ws("|", F.lit(str(seed)), replicate.cast("string"), slot.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n


def resampled(values: DataFrame, by: list[str], group: str | None, repeats: int = REPEATS, seed: int = 0) -> DataFrame:
    """values (by, value, and group or query_id) -> by, replicate, mean, of resamples of whole groups (of single
    questions where group is None, or where there is one group only).

    Sums and counts of groups are taken first; resamples are made of those, so their number of rows doesn't grow with
    the questions of a group."""
    if group is None:
        unit = F.col("query_id").cast("string")
    else:
        several = F.min(group).over(Window.partitionBy(*by)) != F.max(group).over(Window.partitionBy(*by))
        values = values.withColumn("__several", F.coalesce(several, F.lit(False)))
        unit = F.when(F.col("__several"), F.col(group).cast("string")).otherwise(F.col("query_id").cast("string"))
    totals = values.withColumn("__unit", unit).groupBy(*by, "__unit").agg(F.sum("value").alias("s"), F.count("*").alias("c"))
    order = Window.partitionBy(*by).orderBy("__unit")
    totals = totals.withColumn("g", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*by)))
    slots = totals.select(*by, F.col("g").alias("slot"), "n").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    slots = slots.withColumn("g", draw(seed, F.col("replicate"), F.col("slot"), F.col("n")))
    drawn = slots.drop("n").join(totals.select(*by, "g", "s", "c"), [*by, "g"])
    return drawn.groupBy(*by, "replicate").agg((F.sum("s") / F.sum("c")).alias("mean"))


def summarize(values: DataFrame, by: list[str], group: str | None, repeats: int = REPEATS, alpha: float = ALPHA, seed: int = 0) -> DataFrame:
    """by, n, mean, lo, hi: percentile intervals, quantiles by linear interpolation. No rows for no values."""
    limits = resampled(values, by, group, repeats, seed).groupBy(*by).agg(F.percentile("mean", alpha / 2).alias("lo"), F.percentile("mean", 1 - alpha / 2).alias("hi"))
    means = values.groupBy(*by).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return means.join(limits, by)


def paired(a: DataFrame, b: DataFrame, by: list[str], group: str | None, repeats: int = REPEATS, alpha: float = ALPHA, seed: int = 0) -> DataFrame:
    """by, diff, lo, hi, p of a - b on the same questions (query_id); groups are those of a."""
    both = a.join(b.select(*by, "query_id", F.col("value").alias("__b")), [*by, "query_id"]).withColumn("value", F.col("value") - F.col("__b"))
    boots = resampled(both, by, group, repeats, seed).groupBy(*by).agg(
        F.percentile("mean", alpha / 2).alias("lo"), F.percentile("mean", 1 - alpha / 2).alias("hi"),
        F.avg((F.col("mean") <= 0).cast("double")).alias("below"), F.avg((F.col("mean") >= 0).cast("double")).alias("above"),
    )
    p = F.least(F.lit(1.0), 2 * F.least("below", "above"))
    return both.groupBy(*by).agg(F.avg("value").alias("diff")).join(boots, by).select(*by, "diff", "lo", "hi", p.alias("p"))


def same_questions(a: DataFrame, b: DataFrame) -> None:
    """Both (query_id, query) must hold the same questions."""
    left, right = a.select("query_id", F.col("query").alias("qa")), b.select("query_id", F.col("query").alias("qb"))
    if not left.join(right, "query_id", "full_outer").where(~F.col("qa").eqNullSafe(F.col("qb"))).isEmpty():
        raise ValueError("results are not on the same questions")


def drawn_means(sums: np.ndarray, counts: np.ndarray, repeats: int, seed: int, cells: int = 1 << 22) -> np.ndarray:
    """Means of resamples of units, with NumPy's generator: for parity with results that were drawn that way.

    A resample is a row of how often each unit is drawn; rows are made in blocks, so memory grows with the units only."""
    generator, n = np.random.default_rng(seed), len(sums)
    block = max(1, cells // n)
    means = []
    for at in range(0, repeats, block):
        rows = min(block, repeats - at)
        drawn = generator.integers(0, n, (rows, n)) + n * np.arange(rows)[:, None]
        times = np.bincount(drawn.ravel(), minlength=rows * n).reshape(rows, n)
        means.append(times @ sums / (times @ counts))
    return np.concatenate(means)


def bootstrap_by(values: DataFrame, by: list[str], group: str | None, repeats: int = REPEATS, alpha: float = ALPHA, seed: int = 0) -> DataFrame:
    """Like summarize with NumPy's draws: one task holds the sums of the units of one key of by. Units are whole groups
    in the order in which query_id meets them, or single questions without a group or with one group only."""
    totals = F.struct(F.min("query_id").alias("first"), F.sum("value").alias("s"), F.count("*").alias("c"))
    single = values.groupBy(*by, F.col("query_id").cast("string").alias("__unit")).agg(totals.alias("t"))
    if group is not None:
        grouped = values.groupBy(*by, F.col(group).cast("string").alias("__unit")).agg(totals.alias("t"))
        several = grouped.groupBy(*by).agg(F.count("*").alias("__n")).where("__n > 1").drop("__n")
        single = grouped.join(several, by, "left_semi").unionByName(single.join(several, by, "left_anti"))
    units = single.select(*by, "t.first", "t.s", "t.c")
    kinds = ", ".join(f"{c} {values.schema[c].dataType.simpleString()}" for c in by)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("first")
        sums, counts = rows["s"].to_numpy(float), rows["c"].to_numpy(float)
        lo, hi = np.quantile(drawn_means(sums, counts, repeats, seed), [alpha / 2, 1 - alpha / 2])
        return pd.DataFrame([{**{c: rows[c].iloc[0] for c in by}, "n": int(counts.sum()), "mean": sums.sum() / counts.sum(), "lo": lo, "hi": hi}])

    return units.groupBy(*by).applyInPandas(one, f"{kinds}, n long, mean double, lo double, hi double")


def cell(mean: Column, lo: Column, hi: Column) -> Column:
    return F.format_string("%.3f [%.2f,%.2f]", mean, lo, hi)


def verdict(p: Column) -> Column:
    return F.when(p < 0.05, "significant").otherwise("not significant")
