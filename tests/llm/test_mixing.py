import pytest
from pyspark.sql import functions as F

from findery.llm import mixing


def fair(sizes):
    """Targets by filling up: whoever is above the cap is fixed at it, the rest is shared again."""
    names = sorted((n for n in sizes if n is not None)) + ([None] if None in sizes else [])
    weight = {n: i % 3 + 1 for i, n in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        rest = [n for n in names if n not in fixed]
        share = (total - sum(fixed.values())) / max(1, sum(weight[n] for n in rest))
        over = [n for n in rest if weight[n] * share > 3 * sizes[n]]
        if not over:
            return {n: fixed.get(n, weight[n] * share) for n in names}
        fixed |= {n: 3 * sizes[n] for n in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, "c": 5, "d": 0}, {"é": 3, "z": 900, "Z": 7, None: 50}, {"a": 0}, {"a": 5}])
def test_targets(spark, sizes):
    rows = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    assert {r.source: r.target for r in rows} == pytest.approx(fair(sizes))


def sized(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, size long, taken string")


def test_sources_meet_their_targets(spark):
    rows = [(i, f"s{i % 4}", (i * 37) % 900, "x") for i in range(4000)] + [(9000 + i, None, 20, "x") for i in range(50)] + [(1, "tiny", 7, "x"), (1, "tiny", 7, "x"), (None, "tiny", 0, "x"), (2, "none", 0, "x")]
    out = mixing.mix(sized(spark, rows)).collect()
    assert len(out) == len(rows)
    totals = {}
    for r in out:
        assert 0 <= r.taken <= 3 * r.size
        totals.setdefault((r.source, r.target), 0)
        totals[r.source, r.target] += r.taken
    assert all(abs(t - target) <= 0.5 for (_, target), t in totals.items())
    again = mixing.mix(sized(spark, rows[::-1]).repartition(7)).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r.size, r.taken)
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_inclusion_follows_probability(spark):
    """Over many documents of one size the shares taken once more come near the fraction of copies left."""
    rows = [(i, "ab"[i % 2], 100, "x") for i in range(6000)]
    out = mixing.mix(sized(spark, rows)).groupBy("source").agg(F.avg(F.col("taken") / F.col("size")).alias("m"), F.max("target").alias("t"), F.max("source_size").alias("s")).collect()
    assert all(r.m == pytest.approx(r.t / r.s, abs=1e-3) for r in out)


def test_edges(spark):
    assert mixing.mix(sized(spark, [])).count() == 0
    zero = mixing.mix(sized(spark, [(1, "a", 0, "x"), (2, None, 0, "x")])).collect()
    assert [(r.taken, r.target) for r in zero] == [(0, 0.0), (0, 0.0)]
    one = mixing.mix(sized(spark, [(1, "a", 9, "x")])).first()
    assert (one.taken, one.target, one.source_size) == (9, 9.0, 9)


def test_many_sources_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(mixing.common.join_params, "__defaults__", (0, 8))
    rows = [(i, f"s{i % 9}", i % 50, "x") for i in range(500)]
    out = mixing.mix(sized(spark, rows))
    assert out.count() == 500
    assert out.groupBy("source").agg((F.abs(F.sum("taken") - F.max("target"))).alias("d")).where("d > 0.5").isEmpty()


def test_columns_of_any_name_stay(spark):
    rows = [(i, f"s{i % 3}", 10 + i, f"mine {i}") for i in range(60)]
    odd = ("__b", "__m", "__key", "__salt", "__v", "__upto", "__end", "part", "lean", "a.b", "__rank")
    plain = spark.createDataFrame(rows, "doc_id long, source string, size long, note string")
    wide = plain.select("*", *(F.concat(F.lit(f"{c} "), "note").alias(c) for c in odd))
    out = mixing.mix(wide)
    assert out.columns == [*wide.columns, "source_size", "target", "taken"]
    expected = {r.doc_id: r.taken for r in mixing.mix(plain).collect()}
    for r in out.collect():
        assert r.taken == expected[r.doc_id] and all(r[c] == f"{c} mine {r.doc_id}" for c in odd)
