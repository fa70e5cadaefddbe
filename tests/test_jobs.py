import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_entry import compare

from findery.operators import chunk
from jobs import passages, retrieval_report, settings

ROOT = Path(__file__).resolve().parents[1]
DOCUMENTS = "/root/testdata/sf0.001/documents.parquet"


@pytest.mark.parametrize("name", ["job1_passages", "job2_retrieval_report"])
def test_jobs_equal_their_sql(spark, name):
    compare(spark, name)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_passages_of_growing_input(spark, tmp_path):
    """Two halves, one after the other, give what both give at once; what is known isn't read or written again."""
    halves = spark.read.parquet(DOCUMENTS).withColumn("half", F.col("doc_id") % 2)
    folder, out, mark = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/mark"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    run = lambda: passages.run(spark, f"{folder}/*", out, mark)
    halves.where("half = 0").coalesce(1).write.parquet(f"{folder}/a")
    first = run()
    assert first["documents"] == halves.where("half = 0").count() and first["passages"] == passages.read(spark, out).count() > 0
    assert run() == {"batches": 0, "documents": 0, "passages": 0}
    old = {p: p.stat().st_mtime_ns for p in Path(out).rglob("*.parquet")}
    halves.where("half = 1").coalesce(1).write.parquet(f"{folder}/b")
    shutil.copytree(folder / "a", folder / "again")  # the same documents in another file
    second = run()
    assert second["documents"] == halves.count() and second["passages"] < passages.read(spark, out).count()
    assert all(p.stat().st_mtime_ns == t for p, t in old.items())
    assert rows_of(passages.read(spark, out)) == rows_of(passages.passages(halves).distinct())
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


def test_a_batch_that_was_not_committed_is_done_again(spark, tmp_path):
    """The last batch's mark is lost, as by a driver that dies: the next run repeats it, without rows twice."""
    spark.read.parquet(DOCUMENTS).coalesce(1).write.parquet(f"{tmp_path}/in")
    run = lambda: passages.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark")
    run()
    whole = rows_of(passages.read(spark, f"{tmp_path}/out"))
    for p in (tmp_path / "mark" / "commits").iterdir():
        if p.name.lstrip(".").startswith("0"):
            p.unlink()
    run()
    assert rows_of(passages.read(spark, f"{tmp_path}/out")) == whole


def test_passages_of_odd_documents(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(1000))
    rows = [(None, "a"), ("", "a"), (" \n\n ", "a"), (long, None), (long, None), (long, "x/y=1"), ("few words", "a")]
    spark.createDataFrame(rows, "text string, source string").withColumn("id", F.lit("other")).write.parquet(f"{tmp_path}/in")
    assert passages.read(spark, f"{tmp_path}/none").count() == 0
    told = passages.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark")
    got = passages.read(spark, f"{tmp_path}/out").collect()
    assert told["documents"] == 7 and len(got) == told["passages"] == 6
    assert {(r.source, r.part, r.n_tokens) for r in got} == {(s, p, n) for s in ("", "x/y=1") for p, n in ((0, 450), (1, 450), (2, 100))}


def test_line_paragraphs(spark):
    text = spark.createDataFrame([("a  b\n\n \nc d e f g",), ("",), (None,)], "t string")
    assert [r[0] for r in text.select(chunk.line_paragraphs(F.col("t"), 2)).collect()] == ["a b\n\nc d\n\ne f\n\ng", "", None]


def test_report_replaces_only_its_retrievers(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the quick brown fox jumps over the dog", "s"), (2, "nothing of the kind is here at all", "s"), (3, None, None)], "doc_id long, text string, source string")
    asked = spark.createDataFrame([(7, "quick brown fox jumps over"), (8, "unknown terms only, for sure")], "item_id long, text string")
    docs.write.parquet(f"{tmp_path}/d")
    asked.write.parquet(f"{tmp_path}/q")
    run = lambda *names, q="q": retrieval_report.run(spark, f"{tmp_path}/d", f"{tmp_path}/{q}", f"{tmp_path}/o", names, depth=10)
    read = lambda: sorted(map(str, retrieval_report.read(spark, f"{tmp_path}/o").collect()))
    assert run("bm25") == {"documents": 3, "questions": 2, "hits": {"bm25": 1}}
    one = read()
    run("overlap")
    both = read()
    assert set(one) < set(both)
    run("bm25")
    assert read() == both
    means = {(r.retriever, r.metric): r.value for r in retrieval_report.read(spark, f"{tmp_path}/o").where("kind = 'mean'").collect()}
    assert means == {(r, m): 0.5 for r in ("bm25", "overlap") for m in retrieval_report.METRICS}
    asked.limit(0).write.parquet(f"{tmp_path}/none")
    run("bm25", "overlap", q="none")
    assert {(r.kind, r.value) for r in retrieval_report.read(spark, f"{tmp_path}/o").collect()} == {("n", 0.0)}
    with pytest.raises(ValueError):
        run("guess")


def test_command_line(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"documents": DOCUMENTS.replace("parquet", "parque[t]"), "output": f"{tmp_path}/wrong", "max_words": 100}))
    command = [sys.executable, "-m", "jobs.passages", "--config", f"{tmp_path}/c.json", "--checkpoint", f"{tmp_path}/mark", "--min-words", "10"]
    # an argument wins over the file
    done = subprocess.run([*command, "--output", f"{tmp_path}/out"], cwd=ROOT, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "new documents in 1 batches" in done.stderr and list((tmp_path / "out").glob("source=*/*.parquet")) and not (tmp_path / "wrong").exists()


def test_changed_settings_come_back(spark):
    with pytest.raises(RuntimeError), settings.changed(spark, spark_sql_shuffle_partitions="3", spark_own_test="x"):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3" and spark.conf.get("spark.own.test") == "x"
        raise RuntimeError
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4" and spark.conf.get("spark.own.test", None) is None
