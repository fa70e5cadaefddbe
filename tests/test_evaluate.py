import random
import sys

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

from findery.functions import fuzzy, prompt
from findery.operators import answer, calibrate, judge, metrics, questions, retrieve
from findery.plans import evaluate
from findery.sources import records

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


def slow_ratio(a, b):
    def lcs(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            new = [0]
            for j, d in enumerate(y):
                new.append(row[j] + 1 if c == d else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    short, long = sorted((a, b), key=len)
    best = 0.0
    for x, y in [(short, long)] + [(long, short)] * (len(a) == len(b)):
        for i in range(1 - len(x), len(y)):
            w = y[max(0, i) : i + len(x)]
            best = max(best, 200 * lcs(x, w) / (len(x) + len(w))) if w else best
    return best


@settings(max_examples=400, deadline=None)
@given(st.text("abc", min_size=1, max_size=12), st.text("abc", min_size=1, max_size=25), st.sampled_from([0, 60, 75, 90]))
def test_partial_ratio(a, b, cutoff):
    want = slow_ratio(a, b)
    assert fuzzy.partial_ratio(a, b, cutoff) == pytest.approx(want if want >= cutoff else 0)


def check(spark, evidence, text):
    return spark.createDataFrame([(evidence, text)], "e string, t string").select(judge.evidence_ok(F.col("e"), F.col("t"))).first()[0]


def test_evidence(spark):
    sentence = "TCP Reno halves its congestion window after three duplicate acknowledgements arrive."
    assert check(spark, sentence, f"Before. {sentence} After.")
    assert check(spark, sentence.replace("three", "3").replace("TCP", "**TCP**"), f"Before. {sentence} After.")
    assert check(spark, f"{sentence} And then some.", sentence)  # the text may be the shorter one
    assert not check(spark, "A quite different statement about routers and links here.", f"Before. {sentence} After.")
    assert not check(spark, "short", "short and more") and not check(spark, None, "x") and not check(spark, sentence, None)


def test_sections(spark):
    label = [("a", "1 > 2", 1), ("b", "", 1)]
    ok = lambda s, sec: spark.createDataFrame([(s, sec, label)], "s string, sec string, r array<struct<source:string,section:string,page:int>>").select(judge.section_ok(F.col("s"), F.col("sec"), F.col("r"))).first()[0]
    assert ok("a", "1 > 2") and ok("a", "1 > 2 > 3") and not ok("a", "1 > 22") and not ok("c", "1 > 2") and ok("b", None) and not ok("b", "x")
    with pytest.raises(ValueError, match="unknown mode"):
        judge.check_mode("other")


def test_ranks(spark):
    judged = spark.createDataFrame([(1, 1, False), (1, 3, True), (1, 4, True), (2, 1, True), (3, 1, False)], "query_id long, rank int, hit boolean")
    asked = spark.createDataFrame([(1,), (2,), (3,), (4,)], "query_id long")
    rows = metrics.metric_values(judged, asked, ["recall@1", "recall@3", "mrr@2", "mrr@10"]).collect()
    got = {m: [r.value for r in sorted(rows, key=lambda r: r.query_id) if r.metric == m] for m in ("recall@1", "recall@3", "mrr@2", "mrr@10")}
    assert got == {"recall@1": [0, 1, 0, 0], "recall@3": [1, 1, 0, 0], "mrr@2": [0, 1, 0, 0], "mrr@10": [pytest.approx(1 / 3), 1, 0, 0]}
    with pytest.raises(ValueError):
        metrics.parse("recall@0")


def value_rows(spark, values, groups=None):
    return spark.createDataFrame([(i, "m", v, None if groups is None else groups[i]) for i, v in enumerate(values)], "query_id long, metric string, value double, `group` string")


def test_bootstrap_brackets_the_mean(spark):
    rng = random.Random(1)
    values = [float(rng.random() < 0.4) for _ in range(120)]
    r = metrics.summarize(value_rows(spark, values), ["metric"], None, 400).first()
    assert r.lo < r["mean"] < r.hi and r["mean"] == pytest.approx(np.mean(values)) and r.n == 120
    exact = metrics.bootstrap_by(value_rows(spark, values), ["metric"], None).first()
    assert r.lo == pytest.approx(exact.lo, abs=0.03) and r.hi == pytest.approx(exact.hi, abs=0.03) and exact["mean"] == pytest.approx(r["mean"]) and exact.n == 120


def test_draws_in_blocks_are_those_of_one_matrix():
    rng = np.random.default_rng(8)
    sums, counts = rng.random(37), rng.integers(1, 9, 37).astype(float)
    at = np.random.default_rng(5).integers(0, 37, (300, 37))
    want = sums[at].sum(1) / counts[at].sum(1)
    for cells in (1, 37 * 7, 1 << 22):
        assert metrics.drawn_means(sums, counts, 300, 5, cells) == pytest.approx(want)


def test_clusters_widen_the_interval(spark):
    values, groups = [float(i // 10 % 2) for i in range(200)], [f"g{i // 10}" for i in range(200)]
    wide = metrics.summarize(value_rows(spark, values, groups), ["metric"], "group", 300).first()
    slim = metrics.summarize(value_rows(spark, values, groups), ["metric"], None, 300).first()
    assert wide.hi - wide.lo > 2 * (slim.hi - slim.lo)
    exact = metrics.bootstrap_by(value_rows(spark, values, groups), ["metric"], "group", 300).first()
    means = metrics.drawn_means(np.bincount([i // 10 for i in range(200)], values), np.full(20, 10.0), 300, 0)
    assert (exact["mean"], exact.lo, exact.hi) == pytest.approx((np.mean(values), *np.quantile(means, [0.025, 0.975])))


def test_one_group_falls_back_to_questions(spark):
    values = [float(i % 2) for i in range(40)]
    a = metrics.summarize(value_rows(spark, values, ["g"] * 40), ["metric"], "group", 200).first()
    assert a.lo < a.hi
    rows = value_rows(spark, values, ["g"] * 40)
    assert metrics.bootstrap_by(rows, ["metric"], "group", 200).collect() == metrics.bootstrap_by(rows, ["metric"], None, 200).collect()


def test_paired(spark):
    a, b = value_rows(spark, [1.0, 1.0, 0.0, 1.0] * 20), value_rows(spark, [0.0, 1.0, 0.0, 0.0] * 20)
    r = metrics.paired(a, b, ["metric"], None, 300).first()
    assert r["diff"] == pytest.approx(0.5) and 0 < r.lo < 0.5 < r.hi and r.p < 0.05
    same = metrics.paired(a, a, ["metric"], None, 50).first()
    assert (same["diff"], same.p) == (0, 1)
    with pytest.raises(ValueError):
        metrics.same_questions(spark.createDataFrame([(1, "a")], "query_id long, query string"), spark.createDataFrame([(1, "b")], "query_id long, query string"))


def test_area_brier_and_gap(spark):
    rng = random.Random(2)
    rows = [("k", float(rng.randrange(6)), rng.random() < 0.5) for _ in range(80)]
    pos, neg = [x for _, x, y in rows if y], [x for _, x, y in rows if not y]
    want = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)
    df = spark.createDataFrame([*rows, ("one", 1.0, True)], "k string, x double, y boolean")
    assert {r.k: r.auroc for r in calibrate.auroc(df, ["k"]).collect()} == {"k": pytest.approx(want), "one": None}
    p = spark.createDataFrame([(0.0, False), (1.0, True), (0.55, True), (0.55, False)], "p double, y boolean").withColumn("k", F.lit(1))
    assert p.agg(calibrate.brier(F.col("p"), F.col("y"))).first()[0] == pytest.approx((0.45**2 + 0.55**2) / 4)
    assert calibrate.ece(p, ["k"]).first().ece == pytest.approx(0.05 * 2 / 4)


def test_isotonic(spark):
    data = [(1.0, False), (2.0, True), (3.0, False), (4.0, True), (5.0, False), (6.0, True), (6.0, True), (7.0, True)]
    df = spark.createDataFrame([("k", *r) for r in data], "k string, x double, y boolean")
    steps = [(r.x_from, r.successes, r.n) for r in calibrate.isotonic(df, ["k"]).orderBy("x_from").collect()]
    assert steps == [(1.0, 0, 1), (2.0, 2, 4), (6.0, 3, 3)]
    probe = spark.createDataFrame([("k", x) for x in (-5.0, 1.0, 2.5, 6.0, 99.0)], "k string, x double")
    found = [r.p for r in calibrate.lookup(probe, calibrate.isotonic(df, ["k"]), ["k"]).orderBy("x").collect()]
    assert found == pytest.approx([1 / 3, 1 / 3, 0.5, 0.8, 0.8])
    ones = calibrate.isotonic(spark.createDataFrame([("k", float(i // 10), i < 9 or i >= 10) for i in range(11)], "k string, x double, y boolean"), ["k"], monotone=True)
    assert [r.p for r in ones.orderBy("x_from").collect()] == pytest.approx([10 / 12, 10 / 12])


def test_steps_of_runs_equal_those_of_all(spark):
    rng = random.Random(5)
    rows = [(k, float(rng.randrange(300)), rng.random() < rng.choice([0.2, 0.5, 0.9])) for k in ("a", "b") for _ in range(900)]
    rows += [("a", float(v), v % 3 > 0) for v in range(300)] + [("one", 1.0, True), ("a", None, True)]
    df = spark.createDataFrame(rows, "k string, x double, y boolean").repartition(4)
    whole = calibrate.isotonic(df, ["k"]).toPandas()
    for run in (1, 7, 64):
        found = calibrate.isotonic(df, ["k"], run=run).toPandas()
        assert sorted(map(repr, found.itertuples(index=False))) == sorted(map(repr, whole.itertuples(index=False)))
    plain = calibrate.pool(df.where("k = 'b'").groupBy("k", "x").agg(F.sum(F.col("y").cast("long")).alias("s"), F.count("*").alias("n")).toPandas(), ["k"])
    got = whole[whole.k == "b"].sort_values("x_from")
    assert got.x_from.tolist() == plain.x_from.tolist() and got.successes.tolist() == plain.successes.tolist()


@pytest.mark.parametrize("fanout", [2, 3, 128])
def test_lookup_down_a_tree(spark, fanout):
    import bisect

    rng = random.Random(fanout)
    steps = {k: sorted({float(rng.randrange(100)) for _ in range(n)}) for k, n in (("a", 40), ("b", 1), ("c", 9))}
    table = spark.createDataFrame([(k, v, v / 200) for k, at in steps.items() for v in at], "k string, x_from double, p double")
    probes = [(i, k, x) for i, (k, x) in enumerate((k, x) for k in "abcd" for x in [-1.0, None, float("inf"), *[rng.uniform(-5, 110) for _ in range(20)], *steps.get(k, [])[:5]])]
    got = {r.i: r.p for r in calibrate.lookup(spark.createDataFrame(probes, "i int, k string, x double"), table, ["k"], fanout=fanout).collect()}
    want = {i: None if k not in steps else steps[k][max(0, bisect.bisect_right(steps[k], -9.0 if x is None else x) - 1)] / 200 for i, k, x in probes}
    assert got == want
    none = calibrate.lookup(spark.createDataFrame(probes, "i int, k string, x double"), table.where("false"), ["k"], fanout=fanout)
    assert none.where("p IS NULL").count() == len(probes)


def test_lookup_among_a_million_steps(spark):
    steps = spark.range(1_000_000).select(F.col("id").cast("double").alias("x_from"), (F.col("id") / 2_000_000).alias("p"))
    rows = spark.range(20_000).select("id", (F.col("id") * 50 + 0.5).alias("x"))
    out = calibrate.lookup(rows, steps, [])
    assert out.columns == ["id", "x", "p"] and out.where("p = id * 50 / 2000000").count() == 20_000


def test_signals(spark):
    rows = spark.createDataFrame([([1.0, 4.0, 2.5],), ([2.0],), ([],)], "s array<double>").select(calibrate.signals(F.col("s")).alias("g")).collect()
    assert [tuple(r.g) for r in rows] == [(4.0, 1.5, 1.5), (2.0, 2.0, 0.0), (0.0, 0.0, 0.0)]


def test_holdout(spark):
    df = spark.createDataFrame([(i, f"g{i % 10}") for i in range(100)], "i int, g string")
    rows = calibrate.holdout(df, "g").collect()
    test = {r.g for r in rows if r.is_test}
    assert len(test) == 3 and test.isdisjoint({r.g for r in rows if not r.is_test})
    assert calibrate.holdout_keys([f"g{i}" for i in range(10)]) == calibrate.holdout_keys([f"g{i}" for i in range(9, -1, -1)])


def test_confidence_is_calibrated(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        top = rng.random()
        rows.append((i, f"s{i % 60}", top, rng.random(), rng.random(), rng.random() < top))
    df = spark.createDataFrame(rows, "query_id long, `group` string, top1 double, margin double, spread double, y boolean")
    model = calibrate.fit(df, "bm25")
    assert model.signal == "top1" and model.report["test_brier"] < 0.25 and model.report["test_auroc"] > 0.6
    model.save(spark, f"{tmp_path}/model")
    assert calibrate.ConfidenceModel.load(spark, f"{tmp_path}/model") == model
    hits = spark.createDataFrame([(1, 1, "a", 0.95), (1, 2, "b", 0.2), (2, 1, "a", 0.05)], "query_id long, rank int, id string, score double")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    got = {r.query_id: (r.level, r.probability) for r in model.assess(hits, asked).collect()}
    assert got[1][0] == "high" and got[2][0] == got[3][0] == "low"
    with pytest.raises(ValueError, match="confidence model is of"):
        model.check("dense")
    with pytest.raises(ValueError, match="several sections"):
        calibrate.fit(df.withColumn("group", F.lit("one")), "bm25")


def small_book(spark):
    texts = [(f"c{i}", f"Sentence number {w} explains the {w} protocol in some detail. " + " ".join(f"{w}{k}" for k in range(20)), ("book.md", f"Chapter {i}", i, 0)) for i, w in enumerate(["alpha", "beta", "gamma", "delta", "kappa", "sigma"])]
    chunks = spark.createDataFrame(texts, "id string, text string, metadata struct<source:string,section:string,page:int,part:int>").withColumn("source", F.col("metadata.source"))
    asked = [(i, f"what does the {w} protocol do", "factual" if i % 2 else "keyword", f"Sentence number {w} explains the {w} protocol in some detail.", [("book.md", f"Chapter {i}", i)], f"book.md|Chapter {i}") for i, w in enumerate(["alpha", "beta", "gamma", "delta", "kappa"])]
    asked.append((5, "unknown things", "factual", "This sentence is nowhere to be found in it.", [("book.md", "Chapter 5", 1)], "book.md|Chapter 5"))
    return chunks, spark.createDataFrame(asked, "query_id long, query string, type string, evidence string, relevant array<struct<source:string,section:string,page:int>>, `group` string")


def test_evaluation_from_end_to_end(spark, tmp_path):
    chunks, asked = small_book(spark)
    judged = evaluate.judge_all(asked, chunks, {"bm25": retrieve.bm25, "stub": retrieve.overlap}, 5)
    assert judged["bm25"].where("rank = 1 AND hit_evidence AND hit_section").count() == 5
    made = evaluate.report(judged, asked, "evidence", ks=(1, 5), mrr_k=5, repeats=50)
    cells = {(r.retriever, r.metric): r["mean"] for r in made.summary.collect()}
    assert cells["bm25", "recall@1"] == pytest.approx(5 / 6) and made.comparison.first().verdict == "not significant"
    assert {r.type: r.n for r in made.by_type.where("retriever = 'bm25'").collect()} == {"factual": 3, "keyword": 3}
    saved = judge.results(judged["bm25"], asked, chunks, 5)
    records.write(saved.drop("query_id"), f"{tmp_path}/bm25.jsonl")
    back = records.read_results(spark, f"{tmp_path}/bm25.jsonl")
    assert records.results_depth(back) == 5 and {r.retriever for r in back.collect()} == {"bm25"}
    assert records.exploded(back).where("hit_evidence").count() == judged["bm25"].where("hit_evidence").count()
    other = asked.withColumn("relevant", F.array(F.struct(F.lit("x").alias("source"), F.lit("").alias("section"), F.lit(1).alias("page"))))
    with pytest.raises(ValueError, match="other sources"):
        evaluate.judge_all(other, chunks, {"bm25": retrieve.bm25}, 5)


def test_citations(spark):
    cite = lambda t: spark.createDataFrame([(t,)], "t string").select(prompt.citations(F.col("t"), F.lit(3)).alias("c")).first().c
    for text, valid, invalid in [("a [1] b", [1], []), ("[1][3]", [1, 3], []), ("[2, 3]", [2, 3], []), ("[1; 2][2]", [1, 2], []), ("[0] [7]", [], [0, 7]), ("a[i] [x]", [], []), ("", [], []), ("[[1]] [2", [1], []), ("[1,] [,2] [1 2] [ 3 ]", [], []), ("[1 ,3;2]", [1, 2, 3], []), ("[]", [], []), ("x[2][y]", [2], []), ("[99999999999999999999999] [2]", [2], [])]:
        assert (cite(text).valid, cite(text).invalid) == (valid, invalid)


class Scripted:
    name = "scripted"

    def __init__(self, *pieces):
        self.pieces, self.seen = pieces, []

    def stream(self, messages):
        self.seen.append(messages)
        yield from self.pieces


def test_answers_grow_and_are_checked(spark):
    chunks, _ = small_book(spark)
    chat = Scripted("It is ", "so [1]", "[9]. ")
    reply = answer.ask("alpha protocol", chunks, retrieve.bm25, chat, k=2)
    assert reply.waiting and reply.row["text"] is None and len(reply.row["hits"]) == 2 and not chat.seen
    assert list(reply) == ["It is ", "so [1]", "[9]. "] and not reply.waiting
    assert (reply.row["text"], reply.row["cited"], reply.row["invalid_citations"], reply.row["llm_used"]) == ("It is so [1][9].", [1], [9], True)
    assert chat.seen[0][1]["content"].startswith("alpha protocol\n-----\n[1] (book.md, p. 0)\nSentence number alpha")
    none = answer.ask("zzz", chunks, retrieve.bm25, chat)
    assert not none.waiting and list(none) == [] and none.row["text"] == answer.NO_HITS and not none.row["llm_used"] and none.row["cited"] == [] and len(chat.seen) == 1


def test_gate_and_batch_answers(spark):
    chunks, asked = small_book(spark)
    model = calibrate.ConfidenceModel("bm25", "top1", 4, "evidence", [(0.0, 0.1), (0.5, 0.9)])
    rows = answer.prepare(asked.select("query_id", "query"), chunks, retrieve.bm25, 2, model, max_context=1, skip_when_low=True)
    done = {r.query_id: r for r in answer.complete(rows, Scripted("See [1] ")).collect()}
    assert done[0].route == "llm" and done[0].text == "See [1]" and done[0].cited == [1] and len(done[0].hits) == 2 and len(done[0].context) == 1
    assert done[5].route == "no_hits" and done[5].text == answer.NO_HITS and not done[5].llm_used
    low = calibrate.ConfidenceModel("bm25", "top1", 4, "evidence", [(0.0, 0.1)])
    kept = answer.prepare(asked.select("query_id", "query"), chunks, retrieve.bm25, 2, low, skip_when_low=True).where("query_id = 0").first()
    assert kept.route == "low_confidence" and kept.messages is None


def test_cards(spark):
    hit = ("c<1>", "s&1", None, 3, None, 0.12345, "<b>")
    schema = "h array<struct<id:string,source:string,section:string,page:int,part:int,score:double,text:string>>"
    card = spark.createDataFrame([([hit],)], schema).select(prompt.hit_cards(F.col("h"), F.array(F.lit(1).cast("bigint")))).first()[0]
    assert card == "<ol><li><article data-cited><h3>(no heading)</h3><data>0.123</data><dl><dt>source</dt><dd>s&amp;1</dd><dt>page</dt><dd>3</dd><dt>chunk</dt><dd>c&lt;1&gt;</dd></dl><p>&lt;b&gt;</p></article></li></ol>"
    assert "<p>Nothing found.</p>" in spark.createDataFrame([([],)], schema).select(prompt.hit_cards(F.col("h"), F.array().cast("array<bigint>"))).first()[0]


def test_question_run(spark):
    base = "This is a long enough sentence about protocol number"
    sections = spark.createDataFrame([("d", "b.md", i, ["A", "Homework"] if i == 4 else ["A", f"S{i}"], " ".join(f"{base} {i}." for _ in range(15)), i) for i in range(6)], "doc string, source string, section_no int, path array<string>, text string, page int")
    chosen = questions.in_fixed_order(questions.eligible(sections), 10)
    assert chosen.count() == 5 and questions.eligible(sections, high=100).count() == 0
    first = [r.section_no for r in chosen.orderBy("ask_order").collect()]
    assert first[:2] == [r.section_no for r in questions.in_fixed_order(questions.eligible(sections), 2).orderBy("ask_order").collect()]

    def llm(text):
        k = text.split("Section: A > S")[1][0]
        if k == "3":
            raise ValueError("no JSON")
        good = f"{base} {k}."
        return [{"query": f" What  about {k}?", "type": "factual", "evidence": good}, {"query": f"what about {k}?", "type": "keyword", "evidence": good}, {"query": "", "type": "factual", "evidence": good}, {"query": "q", "type": "odd", "evidence": good}, {"query": "why", "type": "factual", "evidence": "An invented sentence that stands nowhere."}, {"query": "n", "type": "factual", "evidence": None}]

    progress = spark.createDataFrame([("b.md|1|A > S1",)], "key string")
    todo = questions.todo(chosen, progress)
    replies = questions.ask(todo, llm)
    rows = questions.reply_questions(replies)
    seen = spark.createDataFrame([("What about 2?",)], "query string")
    checked = questions.validate(rows, seen, ["key", "ordinal"])
    reasons = {}
    for r in checked.collect():
        reasons.setdefault(r.key, {})[r.ordinal] = r.reason
    fresh = {0: None, 1: "duplicate", 2: "malformed", 3: "malformed", 4: "evidence not in section", 5: "malformed"}
    assert reasons == {"b.md|0|A > S0": fresh, "b.md|5|A > S5": fresh, "b.md|2|A > S2": {**fresh, 0: "duplicate"}}
    assert tuple(questions.stats(replies, checked, 1).first()) == (3, 2, 16, 1, 1)
    assert {r.key: (r.kept, r.rejected) for r in questions.progress_rows(replies, checked).collect()}["b.md|2|A > S2"] == (0, 6)
