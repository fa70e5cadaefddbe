import random

import pytest
from pyspark.sql import functions as F
from test_entry import compare

from findery.operators import retrieve
from findery.sources.inverted import InvertedIndex, forward


@pytest.mark.parametrize("name", ["bm25_index_topk", "bm25_index_delta", "cells_topk_exact"])
def test_queries_equal_their_sql(spark, name):
    compare(spark, name)


def corpus(n, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    return [(f"c{i}", f"s{i % 5}", " ".join(["The", *rng.choices(vocabulary, [1 / (k + 1) for k in range(60)], k=rng.choice((5, 20, 80)))])) for i in range(n)]


def chunks(spark, rows):
    return spark.createDataFrame(rows, "id string, source string, text string")


def hits(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "the w40 w3", None), (2, "w1", "s2"), (3, "the", None), (4, "nowhere", None), (5, "", None)], "query_id long, query string, source string")


def test_deltas_equal_a_rebuild(spark, tmp_path, asked):
    """Added, changed and removed chunks: after each sync scores are those of an index, and of a search, of all texts."""
    one = corpus(300)
    two = [(i, s, t + " w59" if s == "s1" else t) for i, s, t in one if s != "s4" and not (s == "s0" and i.endswith("0"))] + [("new", "s3", "w40 the the")]
    two = [(f"{i}'" if s == "s1" else i, s, t) for i, s, t in two]
    kept = InvertedIndex(spark, f"{tmp_path}/kept", buckets=4)
    assert kept.search(asked).count() == 0
    assert kept.sync(chunks(spark, one)) == {"added": 300, "deleted": 0, "kept": 0}
    assert hits(kept.search(asked)) == hits(retrieve.bm25(asked, chunks(spark, one)))
    removed = len([i for i, s, _ in one if s == "s1" or (s == "s0" and i.endswith("0"))])
    stats = kept.sync(chunks(spark, two))
    assert stats == {"added": 61, "deleted": removed, "kept": len(two) - 61}
    assert kept.sync(chunks(spark, two))["kept"] == len(two) and len(kept._segments()) == 2
    assert kept.remove_source("s4") == 60 and kept.remove_source("s4") == 0
    exact = hits(retrieve.bm25(asked, chunks(spark, two)))
    assert hits(kept.search(asked)) == exact
    again = InvertedIndex(spark, f"{tmp_path}/again", buckets=4)
    again.sync(chunks(spark, two))
    assert hits(again.search(asked)) == exact
    # a chunk that comes back counts again
    kept.sync(chunks(spark, [r for r in one if r[1] == "s4"]))
    whole = two + [r for r in one if r[1] == "s4"]
    assert hits(kept.search(asked)) == hits(retrieve.bm25(asked, chunks(spark, whole)))


def test_blocks_that_cannot_reach_are_not_read(spark, tmp_path):
    """A word that all chunks have: a part of its postings is enough for the best five."""
    rows = corpus(3000, 2)
    kept = InvertedIndex(spark, f"{tmp_path}/i", buckets=4)
    kept.sync(chunks(spark, rows))
    common = spark.createDataFrame([(1, "the")], "query_id long, query string")
    looked = kept.candidates(common, 5, first=2)
    read, there = looked.postings()
    assert there == 3000 and read < 1500
    assert hits(retrieve.ranked(looked.found, 5)) == hits(retrieve.bm25(common, chunks(spark, rows)))


def test_a_second_writer_fails(spark, tmp_path, monkeypatch):
    kept, other = (InvertedIndex(spark, f"{tmp_path}/i", buckets=2) for _ in range(2))
    old = other._segments()
    kept.sync(chunks(spark, corpus(5)))
    monkeypatch.setattr(other, "_segments", lambda: old)
    with pytest.raises(RuntimeError):
        other.sync(chunks(spark, corpus(6)))
    monkeypatch.undo()
    assert other.search(spark.createDataFrame([(1, "the")], "query_id long, query string"), 9).count() == 5


def test_forward_rows(spark):
    rows = chunks(spark, [("a", None, "b A b"), ("n", "s", None), ("e", "s", "")])
    got = {r.id: (r.source, r.n_words, {t.term: t.tf for t in r.terms}) for r in forward(rows).collect()}
    assert got == {"a": ("", 3, {"a": 1, "b": 2}), "n": ("s", 0, {}), "e": ("s", 0, {})}
    long = spark.range(1).select(F.lit("x").alias("id"), F.lit("s").alias("source"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(200_000)), lambda i: F.concat(F.lit("w"), (i % 50_000).cast("string"))), " ").alias("text"))
    assert forward(long).select(F.size("terms"), F.array_max(F.transform("terms", lambda t: t.tf))).first()[:] == (50_000, 4)


def test_neither_texts_nor_postings_are_kept_or_shuffled_on_the_way(spark, tmp_path, monkeypatch):
    """A first sync inverts texts where they are read and stages keys only; a task of a search passes on its best hits."""
    from findery.sources import inverted

    staged, real = [], inverted.stage
    monkeypatch.setattr(inverted, "stage", lambda df, name: staged.append(df.columns) or real(df, name))
    rows = chunks(spark, corpus(2000, 3))
    assert "Exchange" not in inverted.posted(forward(rows))._jdf.queryExecution().executedPlan().toString()
    kept = InvertedIndex(spark, f"{tmp_path}/i", buckets=4)
    kept.sync(rows)
    assert staged and not any({"text", "terms"} & set(c) for c in staged)
    found = kept.candidates(spark.createDataFrame([(1, "the")], "query_id long, query string"), 5).found
    assert 5 <= found.count() <= 5 * found.rdd.getNumPartitions() < 2000


def test_blocks_hold_what_the_chunks_have(spark):
    """Pools of few postings and chunks of many words: no block has more chunks than it may, and all words are there."""
    from findery.sources.inverted import MEMBERS, posted

    rows = chunks(spark, [*corpus(500, 4), ("none", "s", None), ("long", "s", " ".join(f"x{i}" for i in range(3000)))])
    made = posted(forward(rows), per_block=7, pool=900).collect()
    members = {r.block: list(zip(r.ids, r.n_words)) for r in made if r.term is None}
    assert MEMBERS < 0 and max(map(len, members.values())) <= 7 and sum(map(len, members.values())) == 502
    got = {(members[r.block][slot][0], r.term): tf for r in made if r.term is not None for slot, tf in zip(r.slots, r.tfs, strict=True)}
    assert got == {(r.id, t.term): t.tf for r in forward(rows).collect() for t in r.terms}
    for r in made:
        if r.term is not None:
            assert (r.n, r.max_tf, r.min_words) == (len(r.slots), max(r.tfs), min(members[r.block][slot][1] for slot in r.slots))


def test_a_source_that_loses_chunks_beside_a_repeated_one(spark, tmp_path, asked):
    """Equal ids in two sources, and repeated ones with two texts: the first text counts, and only the source's own chunk goes."""
    kept = InvertedIndex(spark, f"{tmp_path}/i", buckets=2)
    kept.sync(chunks(spark, [("a", "s1", "the w40"), ("a", "s1", "the w3 w3"), ("a", "s2", "w1 the"), ("b", "s2", "w1")]))
    kept.sync(chunks(spark, [("b", "s2", "w1")]))
    left = chunks(spark, [("a", "s1", "the w3 w3"), ("b", "s2", "w1")])
    assert hits(kept.search(asked)) == hits(retrieve.bm25(asked, left))
