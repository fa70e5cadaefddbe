"""Calibrated confidence: from the scores of a retriever's hits to the probability that one of them is relevant."""

from __future__ import annotations

import json
import random
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import bounded, stage

SIGNALS = ("top1", "margin", "spread")
LEVELS = ((0.8, "high"), (0.5, "medium"), (0.0, "low"))
BINS = 10
RUN = 65_536  # values of x that one task pools at first
FANOUT = 128  # steps of a node of a search tree
NODES = 10_000  # nodes of a level that may be broadcast


def signals(scores: Column) -> Column:
    """struct(top1, margin, spread) of an array of scores; the second of one score is 0, of no scores all are 0."""
    s = F.reverse(F.array_sort(scores))
    top, second = F.coalesce(F.get(s, F.lit(0)), F.lit(0.0)), F.coalesce(F.get(s, F.lit(1)), F.lit(0.0))
    mean = F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.lit(1), F.size(s))
    return F.struct(top.alias("top1"), (top - second).alias("margin"), (top - mean).alias("spread"))


def hit_signals(hits: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """query_id, top1, margin, spread of the first k hits of each question; 0 for those without hits."""
    listed = hits.where(F.col("rank") <= k).groupBy("query_id").agg(F.collect_list("score").alias("scores"))
    rows = questions.select("query_id").join(listed, "query_id", "left").select("query_id", signals(F.coalesce("scores", F.array().cast("array<double>"))).alias("s"))
    return rows.select("query_id", "s.*")


def auroc(rows: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """by, auroc: the chance that a success has the greater x, ties count half; null without both kinds.

    Successes and failures are counted by value; the sum of ranks follows from running counts over distinct values."""
    counts = rows.groupBy(*by, x).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.count("*").alias("n"))
    order = Window.partitionBy(*by).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("neg", F.col("n") - F.col("pos")).withColumn("below", F.coalesce(F.sum("neg").over(order), F.lit(0)))
    wins = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2))
    pairs = F.sum("pos") * F.sum("neg")
    return counts.groupBy(*by).agg(F.when(pairs > 0, wins / pairs).alias("auroc"))


def brier(p: Column, y: Column) -> Column:
    return F.avg(F.pow(p - y.cast("double"), 2))


def ece(rows: DataFrame, by: list[str], p: str = "p", y: str = "y", bins: int = BINS) -> DataFrame:
    """by, ece: the mean gap between predicted and seen rates over bins of p, weighted by their size."""
    binned = rows.withColumn("__bin", F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)))
    gaps = binned.groupBy(*by, "__bin").agg(F.count("*").alias("n"), F.abs(F.avg(p) - F.avg(F.col(y).cast("double"))).alias("gap"))
    return gaps.groupBy(*by).agg((F.sum(F.col("gap") * F.col("n")) / F.sum("n")).alias("ece"))


def turn(a: list[int], b: list[int], c: list[int]) -> int:
    """Above 0 if the way from a over b to c bends upwards."""
    return (b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0])


def pool(rows: pd.DataFrame, by: list[str]) -> pd.DataFrame:
    """Isotonic regression of counts by value: the steps are the edges of the greatest convex line below the points
    (examples so far, successes so far), whose slopes rise strictly."""
    rows = rows.sort_values("x")
    x = rows["x"].to_numpy()
    points = np.vstack([[0, 0], np.cumsum(rows[["n", "s"]].to_numpy(np.int64), axis=0)]).tolist()
    hull = [0]
    for k in range(1, len(points)):
        while len(hull) > 1 and turn(points[hull[-2]], points[hull[-1]], points[k]) <= 0:
            hull.pop()
        hull.append(k)
    first = {c: rows[c].iloc[0] for c in by}
    edges = [(x[a], points[b][1] - points[a][1], points[b][0] - points[a][0]) for a, b in zip(hull, hull[1:], strict=False)]
    return pd.DataFrame([{**first, "x_from": v, "successes": s, "n": n, "p": (s + 1) / (n + 2)} for v, s, n in edges])


def in_runs(rows: DataFrame, by: list[str], run: int) -> DataFrame:
    """rows (by, x, ...) with __part and __run: runs of at most so many rows of a key whose x follow each other. Rows are
    put in ranges of keys and x first, and each range of a key is numbered by itself."""
    order = F.col("x").asc_nulls_last()
    parts = rows.repartitionByRange(*by, order).withColumn("__part", F.spark_partition_id())
    return parts.withColumn("__run", F.floor((F.row_number().over(Window.partitionBy(*by, "__part").orderBy(order)) - 1) / run))


def isotonic(rows: DataFrame, by: list[str], x: str = "x", y: str = "y", monotone: bool = False, run: int = RUN) -> DataFrame:
    """by, x_from, successes, n, p: steps with a rising rate of success, smoothed by one success and one failure.

    Smoothing may turn two steps around; monotone takes the running maximum. Rows are counted by value of x first. Then
    each run of at most `run` values of a key is pooled by itself, and a key's steps come from those of its runs: a corner of
    the line below all points is one of the line below its run, so a task never gets all values of a key."""
    counts = rows.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("long").alias("s")).groupBy(*by, "x").agg(F.sum("s").alias("s"), F.count("*").alias("n"))
    kinds = "".join(f"{c} {counts.schema[c].dataType.simpleString()}, " for c in by) + "x_from double, successes long, n long, p double"
    runs = in_runs(counts, by, run).groupBy(*by, "__part", "__run").applyInPandas(lambda pdf: pool(pdf, by), kinds)
    steps = runs.select(*by, F.col("x_from").alias("x"), F.col("successes").alias("s"), "n").groupBy(*by).applyInPandas(lambda pdf: pool(pdf, by), kinds)
    if not monotone:
        return steps
    return steps.withColumn("p", F.max("p").over(Window.partitionBy(*by).orderBy("x_from").rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def search_tree(steps: DataFrame, by: list[str], fanout: int = FANOUT) -> list[DataFrame]:
    """Steps (by, x_from, p) as levels of nodes, the root first: by, __lo, __steps, an array of at most `fanout` (x_from, p)
    in order, where __lo is the first x_from. Entries above the leaves are the __lo of nodes below. Each level is written."""
    levels: list[DataFrame] = []
    entries = steps.groupBy(*by, F.col("x_from").alias("x")).agg(F.max("p").alias("p"))
    while True:
        nodes = in_runs(entries, by, fanout).groupBy(*by, "__part", "__run").agg(F.array_sort(F.collect_list(F.struct(F.col("x").alias("x_from"), "p"))).alias("__steps"))
        levels.insert(0, stage(nodes.select(*by, F.get("__steps", F.lit(0))["x_from"].alias("__lo"), "__steps"), "steps"))
        if (levels[0].groupBy(*by).count().agg(F.max("count")).first()[0] or 0) <= 1:
            return levels
        entries = levels[0].select(*by, F.col("__lo").alias("x"), F.lit(None).cast("double").alias("p"))


def lookup(rows: DataFrame, steps: DataFrame, by: list[str], x: str = "x", fanout: int = FANOUT) -> DataFrame:
    """rows with p of the last step that begins at or before x, of the first step if x is below all or null; null for a key
    without steps. Of steps that begin at one x the greatest p counts.

    As-of join down a search tree: a join a level, by key and node, after which at most `fanout` entries are compared. Few
    steps are one level. A level is broadcast after a count, else rows of a node much looked up are for AQE to split."""
    keys = by or ["__all"]  # without keys there is one tree
    if not by:
        rows, steps = rows.withColumn("__all", F.lit(0)), steps.withColumn("__all", F.lit(0))
    for depth, nodes in enumerate(search_tree(steps, keys, fanout)):
        on = [*keys, "__lo"] if depth else keys
        rows = rows.join(bounded(nodes if depth else nodes.drop("__lo"), NODES), on, "left").drop("__lo")
        passed = F.filter("__steps", lambda s: s["x_from"] <= F.col(x))
        step = F.when(F.size(passed) > 0, F.element_at(passed, -1)).otherwise(F.get("__steps", F.lit(0)))
        rows = rows.withColumn("__step", step).drop("__steps").withColumns({"__lo": F.col("__step.x_from"), "p": F.col("__step.p")}).drop("__step")
    return rows.drop("__lo", *([] if by else ["__all"]))


def level(p: Column) -> Column:
    out = None
    for cut, name in LEVELS[:-1]:
        out = F.when(p >= cut, name) if out is None else out.when(p >= cut, name)
    return out.otherwise(LEVELS[-1][1])


def holdout(rows: DataFrame, group: str, share: float = 0.3, seed: int = 0) -> DataFrame:
    """rows with is_test: whole groups, in the order of a hash, the first round(share * groups) of them."""
    keys = rows.select(group).distinct()
    order = Window.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(group).cast("string"), F.lit("")))), group)
    ranks = keys.withColumn("__k", F.row_number().over(order)).withColumn("__n", F.count("*").over(Window.partitionBy()))
    ranks = ranks.select(F.col(group).alias("__g"), (F.col("__k") <= F.bround(F.col("__n") * F.lit(share))).alias("is_test"))
    return rows.join(ranks, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


def holdout_keys(keys: list[str], share: float = 0.3, seed: int = 0) -> set[str]:
    """Test groups by a seeded shuffle of the sorted distinct keys, as Python's generator gives it."""
    groups = sorted(set(keys), key=str)
    random.Random(seed).shuffle(groups)
    return set(groups[: round(len(groups) * share)])


@dataclass
class ConfidenceModel:
    """Of one retriever, for the first k hits, under one mode of relevance."""

    retriever: str
    signal: str
    k: int
    mode: str
    steps: list[tuple[float, float]]
    report: dict = field(default_factory=dict)

    def probability(self, x: Column) -> Column:
        steps = F.array(*(F.struct(F.lit(float(a)).alias("x_from"), F.lit(float(p)).alias("p")) for a, p in self.steps))
        passed = F.filter(steps, lambda s: s["x_from"] <= x)
        return F.when(F.size(passed) > 0, F.element_at(passed, -1)["p"]).otherwise(float(self.steps[0][1]))

    def assess(self, hits: DataFrame, questions: DataFrame) -> DataFrame:
        """query_id, top1, margin, spread, probability, level."""
        rows = hit_signals(hits, questions, self.k).withColumn("probability", self.probability(F.col(self.signal)))
        return rows.withColumn("level", level(F.col("probability")))

    def check(self, retriever: str) -> None:
        if retriever != self.retriever:
            raise ValueError(f"the confidence model is of {self.retriever!r}, not of {retriever!r}")

    def save(self, spark: SparkSession, path: str) -> None:
        text = json.dumps(asdict(self), indent=2)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ConfidenceModel:
        found = json.loads(spark.read.text(path, wholetext=True).first()[0])
        return cls(**{**found, "steps": [tuple(s) for s in found["steps"]]})


def fit(rows: DataFrame, retriever: str, k: int = 5, mode: str = "evidence", share: float = 0.3, seed: int = 0) -> ConfidenceModel:
    """rows (query_id, group, top1, margin, spread, y) -> a model: the signal with the best AUROC outside the test
    groups (of equal ones the first), checked on the test groups, then fitted on all."""
    split = holdout(rows, "group", share, seed).persist()
    try:
        n_train, n_test, rate = split.agg(F.count(F.when(~F.col("is_test"), 1)), F.count(F.when(F.col("is_test"), 1)), F.avg(F.col("y").cast("double"))).first()
        if not n_train or not n_test:
            raise ValueError("questions of several sections are needed to fit and check confidence")
        each = F.explode(F.array(*(F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("x")) for s in SIGNALS)))
        flat = split.select("y", "is_test", each.alias("e")).select("y", "is_test", "e.*")
        train = {r.signal: r.auroc for r in auroc(flat.where(~F.col("is_test")), ["signal"]).collect()}
        signal = max(SIGNALS, key=lambda s: -1.0 if train.get(s) is None else train[s])
        mine = flat.where(F.col("signal") == signal)
        tested = lookup(mine.where("is_test"), isotonic(mine.where(~F.col("is_test")), ["signal"]), ["signal"])
        quality = tested.agg(brier(F.col("p"), F.col("y"))).first()[0]
        gap, area = ece(tested, ["signal"]).first().ece, auroc(tested, ["signal"]).first().auroc
        final = [(r.x_from, r.p) for r in isotonic(mine, ["signal"]).orderBy("x_from").collect()]  # steps only
    finally:
        split.unpersist()
    short = lambda v: None if v is None else round(v, 3)
    report = {"n_train": n_train, "n_test": n_test, "success_rate": rate, "train_auroc": {s: short(train.get(s)) for s in SIGNALS}, "test_auroc": short(area), "test_brier": short(quality), "test_ece": short(gap)}
    return ConfidenceModel(retriever, signal, k, mode, final, report)
