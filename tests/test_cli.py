from findery import cli


def words(n, tag):
    return " ".join(f"{tag}{i}" for i in range(n))


def test_from_book_to_answer(spark, tmp_path, capsys):
    book = tmp_path / "book.md"
    book.write_text("\n".join(f"# Chapter {w}\nThis sentence is all about the {w} protocol and its uses. {words(130, w)}" for w in ("alpha", "beta", "gamma", "delta")))
    at = lambda name: f"{tmp_path}/{name}"
    cli.main(["ingest", str(book), "--out", at("chunks.jsonl")], spark)
    cli.main(["index", at("chunks.jsonl"), "--db", at("db")], spark)
    cli.main(["index", "--db", at("db"), "--remove", "book.md"], spark)
    said = capsys.readouterr().out
    assert "4 chunks" in said and "'added': 4" in said and "book.md: 4 removed" in said and "0 vectors" in said

    def llm(text):
        w = text.split("Section: Chapter ")[1].split("\n")[0]
        return [{"query": f"what is the {w} protocol for", "type": "factual", "evidence": f"This sentence is all about the {w} protocol and its uses."}]

    args = cli.parser().parse_args(["questions", str(book), "--out", at("q.jsonl"), "--limit", "3"])
    cli.run_questions(spark, args, llm)
    cli.run_questions(spark, args, llm)
    args.limit = 10
    cli.run_questions(spark, args, llm)
    lines = [x for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert "'kept': 3" in lines[0] and "'already_done': 3" in lines[1] and "'kept': 0" in lines[1] and "'kept': 1" in lines[2]

    common = ["--ks", "1", "3", "--mrr-k", "3", "--primary-k", "1"]
    cli.main(["evaluate", "--eval", at("q.jsonl"), "--chunks", at("chunks.jsonl"), "--retrievers", "bm25", "stub", "--out", at("results"), *common], spark)
    first = capsys.readouterr().out
    assert "bm25                recall@1    1.000" in first and "stub - bm25 (recall@1)" in first
    cli.main(["report", at("results"), "--mode", "evidence", *common], spark)
    again = capsys.readouterr().out
    assert "bm25                recall@1    1.000" in again
    cli.main(["--progress", "ask", "gamma protocol", "--chunks", at("chunks.jsonl"), "--retriever", "bm25", "--llm", "none", "-k", "2"], spark)
    shown = capsys.readouterr()
    assert "Chapter gamma" in shown.out and "ask: " in shown.err and " tasks" in shown.err


def test_progress_of_jobs(spark):
    from findery import progress

    told = []
    with progress.watch(spark, lambda *now: told.append(now), "count", 0.01):
        assert spark.range(0, 1000, 1, 5).selectExpr("id % 7 AS k").groupBy("k").count().count() == 7
    label, done, known = told[-1]
    assert label == "count" and done > 0 and known >= done and [t[1] for t in told] == sorted(t[1] for t in told)
    spark.range(3).count()
    assert told[-1] == (label, done, known)
