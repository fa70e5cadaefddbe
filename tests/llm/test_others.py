import random
import time

import pytest
from pyspark.sql import functions as F

from findery.llm import chat, common, revisits, tokens

RECORD = "record_id long, url string, ts long, status int, etag string, last_modified string, headers array<struct<name:string,value:string>>, n_bytes long, slice string"


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("https://WWW.Example.com:443/A/?b=2&utm_source=x&a=1#frag", "example.com/A?a=1&b=2"), ("http://example.com", "example.com"), ("example.com/", "example.com"),
        ("HTTPS://m.example.com/x.html?ref=1", "m.example.com/x.html"), ("", ""), (None, None),
    ],
)
def test_canonical(spark, url, key):
    assert spark.createDataFrame([(url,)], "url string").select(revisits.canonical(F.col("url"))).first()[0] == key


def test_revisits_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(700):
        url = None if i % 97 == 0 else f"http://h.com/{0 if rng.random() < 0.4 else rng.randrange(30)}"
        etag = rng.choice([None, '"a"', 'W/"a"', '"b"'])
        ts = None if i % 101 == 0 else rng.randrange(300)
        rows.append((i, url, ts, rng.choice([200, 304, 304, 404]), etag, rng.choice([None, "d1", "d2"]), [("Date", str(i))], i, "x"))
    df = spark.createDataFrame(rows, RECORD)
    plain = [r.asDict() for r in df.withColumn("url_key", revisits.canonical(F.col("url"))).collect()]
    for slices in (1, 7, None):
        got = sorted((r.record_id, r.status, r.original_id) for r in revisits.resolve(df, slices).collect())
        assert got == sorted(revisits.brute(plain))
    assert revisits.resolve(df.where("false")).count() == 0


def test_headers_are_merged(spark):
    rows = [(1, "u/", 1, 200, '"a"', None, [("Content-Type", "t"), ("DATE", "1"), ("Vary", "x")], 9, "x"), (2, "http://u", 2, 304, 'W/"a"', None, [("Date", "2"), ("Content-Type", "no"), ("Expires", None), (None, "z")], 0, "x"), (3, "u", 3, 304, '"b"', None, None, 0, "x"), (4, "u", 4, 304, None, None, None, 0, "x")]
    df = spark.createDataFrame(rows, RECORD)
    out = {r.record_id: r for r in revisits.resolve(df).collect()}
    assert out[2].status == "resolved" and out[2].headers == "content-type: t\ndate: 2\nexpires: \nvary: x" and out[2].n_bytes == 9 and out[2].validator == "etag"
    assert out[3].status == "mismatch" and out[3].headers is None and out[4].status == "unchecked" and out[4].original_id == 1
    bodies = revisits.attach_payload(revisits.resolve(df), df.withColumn("body", F.col("etag")), "body")
    assert {r.record_id: r.body for r in bodies.collect()} == {2: '"a"', 3: '"a"', 4: '"a"'}


def test_repeated_headers_stay(spark):
    old = [("Set-Cookie", "b=1"), ("Set-Cookie", "a=2"), ("Vary", "x"), ("vary", "y"), ("Set-Cookie", "b=1")]
    rows = [(1, "u", 1, 200, '"a"', None, old, 9, "x"), (2, "u", 2, 304, '"a"', None, [("Vary", "w"), ("Vary", "v"), ("Set-Cookie", "no")], 0, "x"), (3, "u", 3, 304, '"a"', None, [], 0, "x")]
    out = {r.record_id: r.headers for r in revisits.resolve(spark.createDataFrame(rows, RECORD)).collect()}
    cookies = "set-cookie: b=1\nset-cookie: a=2\nset-cookie: b=1\n"
    assert out == {2: cookies + "vary: w\nvary: v", 3: cookies + "vary: x\nvary: y"}


def test_a_time_far_away_leaves_slices_even(spark):
    """One URL holds all rows, and one of its times lies far from the others."""
    rows = [(i, "u", i if i else 10**15, 200 if i % 3 else 304, None, None, None, i, "x") for i in range(2000)]
    df = spark.createDataFrame(rows, RECORD)
    sizes = []
    stage = common.stage

    def seen(frame, name):
        out = stage(frame, name)
        if name == "captures":
            sizes.extend(r["count"] for r in out.groupBy("slice").count().collect())
        return out

    common.stage = seen
    try:
        got = {r.record_id: r.original_id for r in revisits.resolve(df, 16).collect()}
    finally:
        common.stage = stage
    assert len(sizes) == 16 and max(sizes) < 400
    assert got[3] == 2 and got[1998] == 1997 and got[0] == 1999


def test_ledger(spark, tmp_path):
    ledger = tokens.Ledger(spark, f"file://{tmp_path}/ledger")
    assert ledger.totals().count() == 0
    schema = "source string, lang string, tokenizer string, sign int, n_tokens long"
    first = spark.createDataFrame([("a", "en", "t1", 1, 10), ("a", "en", "t1", 1, 5), ("b", None, "t1", 1, None), (None, "en", "t1", 1, 3)], schema)
    assert ledger.commit("one", first) and ledger.has("one") and not ledger.commit("one", first)
    assert ledger.commit("two", spark.createDataFrame([("a", "en", "t1", -1, 10), ("a", "en", "t2", 1, 12), (None, "en", "t1", -1, 3)], schema))
    assert ledger.commit("none", first.where("false"))
    rows = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in ledger.totals().collect()}
    assert rows == {("a", "en", "t1"): (1, 5), ("b", None, "t1"): (1, 0), ("a", "en", "t2"): (1, 12)}
    with pytest.raises(ValueError):
        ledger.commit("../x", first)


def test_ledger_survives_a_failed_batch(spark, tmp_path):
    ledger = tokens.Ledger(spark, f"file://{tmp_path}/ledger")
    schema = "source string, lang string, tokenizer string, sign int, n_tokens long"
    good = spark.createDataFrame([("a", "en", "t", 1, 4)], schema)
    bad = good.withColumn("n_tokens", F.expr("CASE WHEN sign = 1 THEN cast(raise_error('lost') AS bigint) END"))
    with pytest.raises(Exception, match="lost"):
        ledger.commit("one", bad)
    assert ledger.totals().count() == 0 and ledger.commit("one", good) and ledger.totals().first().n_tokens == 4


def test_two_committers(spark, tmp_path, monkeypatch):
    """Both have seen that the batch isn't there; the sums of one count."""
    first, second = (tokens.Ledger(spark, f"file://{tmp_path}/ledger") for _ in range(2))
    schema = "source string, lang string, tokenizer string, sign int, n_tokens long"
    one, two = (spark.createDataFrame([("a", "en", "t", 1, n)], schema) for n in (4, 7))
    store = tokens.Ledger._store
    taken = []

    def late(self, sums):
        if self is second:
            taken.append(first.commit("x", one))
        return store(self, sums)

    monkeypatch.setattr(tokens.Ledger, "_store", late)
    assert not second.commit("x", two) and taken == [True]
    assert [tuple(r) for r in second.totals().collect()] == [("a", "en", "t", 1, 4)] and len(first.notes.names("data")) == 1 and first.notes.names("pending") == []


def test_compaction(spark, tmp_path, monkeypatch):
    ledger = tokens.Ledger(spark, f"file://{tmp_path}/ledger")
    schema = "source string, lang string, tokenizer string, sign int, n_tokens long"
    batch = lambda k, n: ledger.commit(k, spark.createDataFrame([("a", None, "t", 1 if n > 0 else -1, abs(n))], schema))
    totals = lambda: [tuple(r) for r in ledger.totals().collect()]
    assert not ledger.compact() and batch("a", 5) and batch("b", 6) and ledger.compact() and not ledger.compact()
    assert totals() == [("a", None, "t", 2, 11)] and not batch("a", 5) and batch("c", -5) and totals() == [("a", None, "t", 1, 6)]
    with monkeypatch.context() as m:  # a driver that is lost before the totals are published
        m.setattr(ledger.notes, "put", lambda name, said: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            ledger.compact()
    assert totals() == [("a", None, "t", 1, 6)] and ledger.compact() and totals() == [("a", None, "t", 1, 6)]
    assert len(ledger.notes.names("totals")) == 2 and batch("d", -6) and totals() == []


def test_long_white_space_keeps_its_tokens():
    own = tokens.encoder(tokens.FIRST)
    rng = random.Random(3)
    for run in (" " * 20_000, "\n" * 20_001, " \n\t" * 9_000, "\u3000 " * 15_000, " " * 99, " " * 100, "\t " * 101):
        for text in (f"a{run}b", f"{run}b", f"a {run}", f"a{run}", f"x,{run}1{run} \u00e9{run}", run):
            assert tokens.n_tokens(own, text) == len(own.encode_ordinary(text))
    began = time.time()
    assert tokens.n_tokens(own, f"word{' ' * 19_999}" * 50) > 50 and time.time() - began < 10
    for _ in range(200):
        text = "".join(rng.choice([" ", "\n", " " * 120, "\n" * 101, "a", "b1", "\x1c", "!"]) for _ in range(30))
        assert tokens.n_tokens(own, text) == len(own.encode_ordinary(text))


def test_a_million_blanks_through_the_query(spark, docs_of, tmp_path):
    docs_of([(1, "a" + " " * 1_000_000 + "b", "en", "s"), (2, " " * 1_000_000, "en", "s")]).write.parquet(f"{tmp_path}/documents.parquet")
    rows = tokens.op4_delta_rollup(spark, str(tmp_path)).collect()
    assert sum(r.n_docs for r in rows) == 2 and all(r.n_tokens > 10 for r in rows)


def test_token_counts_and_query(spark, docs_of, tmp_path):
    texts = [None, "", "hello world", "naïve <|endoftext|> 中文 text\n\n x", "a" * 5000, "hello world"]
    docs = docs_of([(i, t, "en", f"s{i % 2}") for i, t in enumerate(texts)] + [(None, "x y", None, None)])
    encode = tokens.encoder(tokens.FIRST)
    assert encode.decode(encode.encode_ordinary(texts[3])) == texts[3]  # a round trip
    counted = tokens.count_tokens(docs.select("doc_id", "text", "kept"), {"n": tokens.FIRST})
    assert {r.doc_id: r.n for r in counted.collect() if r.doc_id is not None} == {i: len(encode.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    import zlib

    second, want = tokens.encoder(tokens.SECOND), {}
    for i, t, lang, source in [*((i, t, "en", f"s{i % 2}") for i, t in enumerate(texts)), (None, "x y", None, None)]:
        part = 9 if i is None else zlib.crc32(str(i).encode()) % 10
        if part:
            name, e = (f"{tokens.SECOND}@2", second) if 1 <= part <= 3 else (f"{tokens.FIRST}@1", encode)
            old = want.get((source, lang, name), (0, 0))
            want[source, lang, name] = old[0] + 1, old[1] + len(e.encode_ordinary(t or ""))
    rows = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in tokens.op4_delta_rollup(spark, str(tmp_path)).collect()}
    assert rows == want


TURNS = "conv_id long, turn long, role string, text string, start int, name string"


@pytest.mark.parametrize("hot", [1000, 2])
def test_rotation(spark, monkeypatch, hot):
    monkeypatch.setattr(common.join_hot, "__defaults__", (hot, *common.join_hot.__defaults__[1:]))
    rows = [(1, 0, "system", "be nice", 0, "x"), (1, 1, "ann", "hi <|im_end|>", 0, "x"), (1, 2, "bob", "é", 0, "x"), (1, 3, None, None, 0, "x"), (1, 3, None, None, 0, "x"), (2, 0, "system", "alone", 0, "x"), (None, 5, "ann", "a", 0, "x"), (None, None, "bob", "b", 0, "x")]
    out = chat.rotate(spark.createDataFrame(rows, TURNS)).collect()
    dialogues = {}
    for r in sorted(out, key=lambda r: r.start):
        dialogues.setdefault((r.conv_id, r.perspective), []).append(r)
    assert set(dialogues) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann"), (None, "bob")}
    for (_, me), turns in dialogues.items():
        whole = "".join(t.rendered for t in turns)
        assert all(whole[t.start : t.start + len(t.rendered)] == t.rendered for t in turns)
        assert whole.count("<|im_end|>") == len(turns)
        for t in turns:
            assert (t.role == "assistant") == (t.mask_start is not None)
            if t.mask_start is not None:
                assert t.name is None and whole[t.mask_start : t.mask_end] == t.rendered.split("\n", 1)[1]
        assert {t.name for t in turns if t.role == "user"}.isdisjoint({me})
    assert [t.role for t in dialogues[1, "bob"]] == ["system", "user", "assistant", "user", "user"]
    assert chat.rotate(spark.createDataFrame([], TURNS)).count() == 0


def test_a_name_stays_in_its_line(spark):
    rows = [(1, 0, "a\nb<|im_end|>", "hi", 0, "x"), (1, 1, "bob\u2028x\r", "yo", 0, "x")]
    out = {(r.perspective, r.turn): r for r in chat.rotate(spark.createDataFrame(rows, TURNS)).collect()}
    assert out["bob\u2028x\r", 0].rendered == "<|im_start|>user name=a b< |im_end|>\nhi<|im_end|>\n" and out["bob\u2028x\r", 0].name == "a b< |im_end|>"
    assert out["a\nb<|im_end|>", 1].rendered == "<|im_start|>user name=bob x \nyo<|im_end|>\n"


def test_prefix_sums_over_ranges(spark):
    rows = [(i % 3 and 1 or None, i, i % 5) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, o int, v int")
    for group in (["g"], []):
        got = {(r.g, r.o): (r.before, r.places) for r in common.prefix_sums(df.withColumn("one", F.lit(1)), group, [F.col("o").asc_nulls_last()], {"before": "v", "places": "one"}).collect()}
        want, run = {}, {}
        for g, o, v in sorted(rows, key=lambda r: r[1]):
            k = g if group else 0
            want[g, o] = run.get(k, (0, 0))
            run[k] = want[g, o][0] + v, want[g, o][1] + 1
        assert got == want


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(Session)


def test_words(spark):
    df = spark.createDataFrame([(None,), ("",), (" ",), (" a\tb ",), ("a",), ("a\x0bb\x1cc é",)], "text string")
    rows = df.select(common.word_count(F.col("text")).alias("n"), common.word_list(F.col("text")).alias("w")).collect()
    assert [r.n for r in rows] == [0, 0, 0, 2, 1, 3] and [r.n for r in rows] == [len(r.w) for r in rows]


def test_join_params(spark):
    big = spark.createDataFrame([(k, i) for i, k in enumerate(["a"] * 50 + ["b", None, None, "z"])], "k string, i int")
    params = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, p int")
    for rows in (100, 0):
        got = sorted((str(r.k), r.i, str(r.p)) for r in common.join_params(big, params, "k", rows, 4).collect())
        assert got == sorted((str(k), i, str({"a": 1, "b": 2, None: 3}.get(k))) for i, k in enumerate(["a"] * 50 + ["b", None, None, "z"]))


@pytest.mark.parametrize(("hot", "keys", "rows"), [(1000, 9, 9), (10, 9, 9), (0, 9, 9), (0, 1, 9), (10, 9, 0), (0, 1, 0)])
def test_join_hot(spark, monkeypatch, hot, keys, rows):
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
    big = spark.createDataFrame([(k, i) for i, k in enumerate(["a"] * 50 + ["b", "b", "z"])], "k string, i int")
    params = spark.createDataFrame([("a", 50, "x"), ("a", 50, "v"), ("b", 2, "y"), ("c", 1, "w")], "k string, n int, p string")
    got = sorted((r.k, r.i, r.n, r.p) for r in common.join_hot(big, params, "k", "n", hot, keys, 4).collect())
    assert got == sorted([*(("a", i, 50, p) for i in range(50) for p in "xv"), ("b", 50, 2, "y"), ("b", 51, 2, "y")])
