import hashlib

import corpus_pipeline as pipeline
from findery.llm import jaccard, pii


def test_stages(spark, docs_of, words, tmp_path):
    passage = words(14, "item")
    clean = [(i, f"{words(60, i)}.", "xx", f"s{i % 3}") for i in range(30)]
    near = words(90, "near").split()
    planted = [
        (100, " ".join(near), "xx", "s0"), (101, " ".join([*near[:-1], "zzz"]), "xx", "s1"), (102, " ".join(near), "xx", "s2"), (103, f"{words(40, 'c')} {passage} {words(30, 'd')}", "xx", "s0"),
        (104, f"{words(40, 'm')} write to a.b@c.de or {words(5, 'n')}", "xx", "s0"), (105, "too short", "xx", "s0"), (106, None, None, None), (107, "", "xx", "s1"), (None, words(50, "q"), None, None), (108, words(50, "r"), None, None), (108, words(50, "r"), None, None),
    ]
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = docs_of(clean + planted)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, rows, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.write.parquet(f"{tmp_path}/{k}")
        rows = spark.read.parquet(f"{tmp_path}/{k}")
        seen[k] = sorted(str(r.doc_id) for r in rows.collect())
        if k < 4:
            assert all(r.kept == "mine" and r.target == "t" for r in rows.collect())
    kept = sorted(str(r[0]) for r in clean)
    assert seen[0] == sorted([*kept, "100", "101", "102", "103", "104", "None", "108", "108"])
    assert seen[1] == sorted([*kept, "100", "103", "104", "None", "108"])
    assert seen[2] == seen[3] == sorted([*kept, "100", "104", "None", "108"])
    masked = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/3").collect()}
    assert "write to <email> or" in masked[104].text and masked[104].n_chars == len(masked[104].text) and masked[0].n_chars == len(clean[0][1])
    mixed = rows.collect()
    assert mixed and all(0 < r.taken <= 3 * r.size for r in mixed)
    assert pipeline.run(spark, str(tmp_path)).count() == len(mixed)


def test_one_document_of_each_class_stays(spark, docs_of, words, tmp_path):
    a, b, c = words(90, "a").split(), words(90, "b").split(), words(90, "c").split()
    near = lambda w, k: " ".join([*w[:-1], f"end{k}"])
    rows = [(1, near(a, k), "xx", "s") for k in range(4)] + [(2, near(a, 9), "xx", "s")] + [(None, near(b, k), "xx", "s") for k in range(4)] + [(None, near(c, 1), "xx", "s"), (9, near(c, 2), "xx", "s"), (9, near(c, 2), "xx", "s")]
    rows += [(i, t, "xx", "s") for i in (5, 5, None, None) for t in (None, "", " \n\t")]
    out = pipeline.near_duplicates(spark, docs_of(rows), str(tmp_path)).collect()
    worded = [(r.doc_id, r.text) for r in out if r.text and r.text.strip()]
    key = lambda t: hashlib.md5(t.encode()).digest()
    first = lambda w: min((near(w, k) for k in range(4)), key=key)
    assert sorted(worded, key=str) == sorted([(1, first(a)), (None, first(b)), (9, near(c, 2))], key=str)
    assert len(out) - len(worded) == 12


def test_empty_documents(spark, docs_of, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs_of([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_names():
    assert [n for n, _ in pipeline.STAGES][:2] == ["quality rules", "n-gram Jaccard join"] and pipeline.ORACLE_SQL is None
    assert jaccard.SIMILAR == (4, 5) and pii.BASE == ("email", "ip", "card", "phone")
