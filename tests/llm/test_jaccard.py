import random

import numpy as np
import pytest

from findery.llm import jaccard


def brute(texts):
    """class (least index of the component), its size, its number of different texts and the number of other texts that
    a text is linked to, for each text."""
    sets = []
    for t in texts:
        w = jaccard.WORDS.findall(t or "")
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    n = len(texts)
    links = [[j for j in range(n) if j != i and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        label = [min([label[i], *(label[j] for j in links[i])]) for i in range(n)]
    degree = [len({texts[j] for j in links[i]} - {texts[i]}) for i in range(n)]
    return [(k, label.count(k), max(1, len({t for t, m in zip(texts, label, strict=True) if m == k and t is not None})), d) for k, d in zip(label, degree, strict=True)]


def copies(words, seed, n, edits):
    rng = random.Random(seed)
    base = words(150, seed).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
        out.append(" ".join(w))
    return out


def test_shingles():
    made = jaccard.Shingles()
    assert len(made.of(None)) == len(made.of(" \n")) == 0 and len(made.of("a b")) == len(made.of("a b c d e")) == 1
    assert (made.of("a b") == jaccard.Shingles().of("a  b")).all() and len(made.of("a b c d e f f")) == 3


def test_runs_reach_the_recall(words):
    assert [jaccard.runs_for(r) for r in (0.5, 0.93, 0.99, 0.9999)] == [1, 1, 2, 4]
    made = jaccard.Shingles()
    pairs, missed = 0, [0, 0]
    for seed in range(800):
        x, y = map(made.of, copies(words, seed, 2, 2))
        if 0.8 <= len(np.intersect1d(x, y)) / len(np.union1d(x, y)) <= 0.87:
            pairs += 1
            for i, runs in enumerate((1, jaccard.runs_for(jaccard.RECALL))):
                missed[i] += not set(jaccard.first_paths(x, runs)) & set(jaccard.first_paths(y, runs))
    assert pairs > 100 and missed[0] <= jaccard.MISS * pairs + 3 * (jaccard.MISS * pairs) ** 0.5 and missed[1] == 0


def classes_of(rows):
    return {r.doc_id: (r.class_id, r.class_size, r.n_texts, r.n_links) for r in rows.collect()}


@pytest.mark.parametrize(("small", "block"), [(64, 512), (3, 4), (8, 16)])
def test_against_brute_force(docs_of, words, monkeypatch, small, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard.leaves_of, "__defaults__", (small,))
    shared = words(30, "license")
    texts = [words(80, i) + " " + shared for i in range(30)]
    for seed in range(6):
        texts += copies(words, seed + 100, 7, 2) + copies(words, seed + 200, 3, 4)
    texts += copies(words, 999, 40, 1) + [texts[0]] * 5 + ["one two", "one two", "one", "one  two", "", "", "   "] + [None, None]
    assert classes_of(jaccard.near_duplicates(docs_of(list(enumerate(texts))), links=True)) == dict(enumerate(brute(texts)))


def spread_copies(words, seed, n, most):
    """Copies of one text with up to so many edits, some of them edits of a copy: part of them are linked, part not."""
    rng = random.Random(seed)
    out = [words(150, seed)]
    for _ in range(n):
        w = (out[0] if rng.random() < 0.7 else rng.choice(out)).split()
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("block", "pivots"), [(32, 16), (32, 1), (64, 2)])
def test_large_leaves_lose_no_class(docs_of, words, monkeypatch, block, pivots):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "PIVOTS", pivots)
    texts = spread_copies(words, 1, 220, 12) + spread_copies(words, 2, 90, 5) + [f"{words(60, 1)} {words(50, i)}" for i in range(60)]
    want = brute(texts)
    assert 40 < len({k[0] for k in want}) < 300 and max(k[1] for k in want) > 50
    assert classes_of(jaccard.near_duplicates(docs_of(list(enumerate(texts))), links=True)) == dict(enumerate(want))


def test_work_of_a_large_group_grows_with_its_sets(spark, docs_of, words, monkeypatch):
    """Where one class holds nearly all of a leaf, tasks get few rows beside its sets; all pairs would be rows times
    blocks (19 here)."""
    monkeypatch.setattr(jaccard, "BLOCK", 32)
    rows = []
    known = jaccard.tasks_of

    def counted(*args):
        rows.append((known(*args).count(), args[0].count()))
        return known(*args)

    monkeypatch.setattr(jaccard, "tasks_of", counted)
    for n in (150, 600):
        near = copies(words, 3, n - 20, 1) + [f"{words(60, 3)} {words(90, i)}" for i in range(20)]
        assert jaccard.near_duplicates(docs_of(list(enumerate(near)))).select("class_id").distinct().count() == 21
    assert rows[1][1] > 5000 and rows[1][0] <= 4 * rows[1][1]


def test_very_long_texts_are_dealt_by_tokens(docs_of, words, monkeypatch):
    monkeypatch.setattr(jaccard, "TOKENS", 100)
    monkeypatch.setattr(jaccard, "BLOCK", 32)
    base = words(3000, "long").split()
    texts = [" ".join([*base[:-1], f"end{k}"]) for k in range(12)] + [words(60, k) for k in range(10)]
    assert classes_of(jaccard.near_duplicates(docs_of(list(enumerate(texts))), links=True)) == dict(enumerate(brute(texts)))


def test_counts_and_stars():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40))).astype(np.uint64) for _ in range(30)]
    got = jaccard.shared_counts(sets[:20], sets[10:])
    assert (got == [[len(np.intersect1d(a, b)) for b in sets[10:]] for a in sets[:20]]).all()
    links = np.zeros((5, 5), bool)
    links[3, 0] = links[0, 4] = links[2, 2] = True
    assert sorted(jaccard.stars([b"d", b"b", b"c", b"a", b"e"], links)) == [(b"a", b"a"), (b"d", b"a"), (b"e", b"a")]


def test_bands_spare_comparisons(spark, words, monkeypatch):
    """A large class near its middle set is counted without comparing its sets; counts of others equal all comparisons."""
    monkeypatch.setattr(jaccard, "BLOCK", 32)
    made = jaccard.Shingles()
    texts = [*copies(words, 5, 200, 1), *spread_copies(words, 6, 150, 12)]
    sets = [made.of(t) for t in texts]
    tids = [bytes([i // 256, i % 256]) * 8 for i in range(len(texts))]
    label = [b"near"] * 200 + [b"wide"] * 151
    rows = spark.createDataFrame([(bytearray(t), bytearray(s.tobytes()), len(s)) for t, s in zip(tids, sets, strict=True)], "tid binary, tokens binary, size int")
    members = spark.createDataFrame([(bytearray(k), bytearray(t)) for k, t in zip(label, tids, strict=True)], "label binary, tid binary")
    got = {bytes(r.tid): r.n_links for r in jaccard.link_counts(members, rows).collect()}
    links = jaccard.linked(sets, sets) & (np.array(label)[:, None] == np.array(label)[None, :])
    assert [got[t] for t in tids] == (links.sum(1) - 1).tolist() and len(set(got.values())) > 5

    placed = jaccard.banded(members.join(rows.select("tid", "size"), "tid").selectExpr("*", "200.0D weight", "first(tid) OVER (PARTITION BY label ORDER BY tid) least"), rows.select("tid", "tokens"))
    groups = jaccard.band_groups(placed).where("key.label = CAST('near' AS BINARY)").collect()
    assert sum(r.sure for r in groups) > 0


def test_lone_tokens(spark):
    sets = [("a" * 16, [1, 2, 3]), ("b" * 16, [3, 4]), ("c" * 16, [4, 3])]
    rows = [(bytearray(t.encode()), *np.frombuffer(t.encode(), np.int64).tolist(), bytearray(np.array(k, np.int64).tobytes())) for t, k in sets]
    got = jaccard.single_tokens(spark.createDataFrame(rows, "tid binary, high long, low long, tokens binary")).collect()
    assert [(r.high, r.single) for r in got] == [(rows[0][1], 2)]


def test_sets_are_not_shuffled_to_join_them(spark, docs_of, words, monkeypatch):
    """A step that needs some of the sets, or all, shuffles their names only."""
    known, plans = jaccard.link_counts, []

    def kept(members, sets):
        plans.append(members.select("tid").distinct().join(sets, "tid")._jdf.queryExecution().executedPlan().toString())
        return known(members, sets)

    monkeypatch.setattr(jaccard, "link_counts", kept)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = copies(words, 1, 8, 1)
        assert classes_of(jaccard.near_duplicates(docs_of(list(enumerate(texts))), links=True)) == dict(enumerate(brute(texts)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and plans[0].count("Exchange hashpartitioning") == 1
    assert not spark.sql("SHOW TABLES").where("tableName LIKE 'sets%'").count()


def test_null_and_repeated_ids(docs_of, words):
    a, b = words(60, 1), words(60, 2)
    rows = jaccard.near_duplicates(docs_of([(None, a), (5, a), (5, a), (None, b), (7, None), (8, "")])).collect()
    by = sorted((str(r.doc_id), str(r.class_id), r.class_size, r.n_texts) for r in rows)
    assert by == sorted([("None", "5", 3, 1), ("5", "5", 3, 1), ("5", "5", 3, 1), ("None", "None", 1, 1), ("7", "7", 1, 1), ("8", "8", 1, 1)])


def test_empty(docs_of):
    assert jaccard.near_duplicates(docs_of([])).count() == 0


def test_components(spark):
    chain = [(bytes([i]), bytes([i + 1])) for i in range(20)] + [(bytes([40]), bytes([41])), (bytes([50]), bytes([50]))]
    rows = {r.tid[0]: r.label[0] for r in jaccard.components(spark.createDataFrame(chain, "tid binary, root binary")).collect()}
    assert rows == {**dict.fromkeys(range(21), 0), 40: 40, 41: 40}
