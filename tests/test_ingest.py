import importlib.util
import random

import pytest
from pyspark.sql import functions as F

from findery import schemas
from findery.functions import text as tx
from findery.operators import chunk, clean, sections
from findery.plans import ingest
from findery.sources import files, records


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


def pages(spark, texts, doc="d"):
    return spark.createDataFrame([(doc, f"{doc}.md", i, t) for i, t in enumerate(texts, 1)], schemas.PAGES)


@pytest.mark.parametrize("text", ["", "a", "a\n", "\n", "a\r\nb\x0bc\x85d e", "a\n\n b \n", "x\x1cy\x1dz"])
def test_lines_equal_splitlines(spark, text):
    assert one(spark, text, tx.lines) == text.splitlines()


@pytest.mark.parametrize("text", ["  a b ", "　x\x1f", "\xa0", "", "a  \n b\x85"])
def test_white_space(spark, text):
    assert one(spark, text, tx.strip) == text.strip()
    assert one(spark, text, tx.squeeze) == " ".join(text.split())
    assert one(spark, text, tx.rstrip) == text.rstrip()
    assert one(spark, text, tx.count_words) == len(text.split())


def test_tokens(spark):
    assert one(spark, "Ünder_score, naïve 3²x; don't", tx.tokens) == ["ünder_score", "naïve", "3²x", "don", "t"]


def test_comparable(spark):
    assert one(spark, "**A–B**  “q” ﬁne\n`x`_", tx.comparable) == 'a-b "q" fine x'
    assert one(spark, None, tx.comparable) is None


def test_headers_go_whatever_their_digits(spark):
    book = [f"Chapter {i} • Transport {i * 7}\n\nBody {i * 'q'} text.\nMore words {i * 'x'}\n**{i}** | The Book" for i in range(1, 7)]
    out = [r.text for r in clean.clean_pages(pages(spark, book)).orderBy("page").collect()]
    assert out[0] == "Body q text.\nMore words x" and len(out) == 6


def test_few_pages_keep_their_lines(spark):
    assert clean.boilerplate(pages(spark, ["Head\nx\ny\nz"] * 4)).count() == 0


def test_threshold_grows_with_pages(spark):
    book = [("Often\n" if i < 8 else "") + ("Rare\n" if i < 5 else "") + f"alpha{'abcdefghijklmnopqrstuvwxyz'[i % 26]} {i * 'q'}\nx{i * 'r'}\ny{i * 's'}\nz{i * 't'}" for i in range(200)]
    keys = clean.boilerplate(pages(spark, book)).first()["keys"]
    assert "often" in keys and "rare" not in keys


def test_only_edges_count(spark):
    book = [f"a{c}\nb{c}\nmiddle\nc{c}\nd{c}" for c in "pqrstu"]
    assert clean.boilerplate(pages(spark, book)).count() == 0


def test_lines_and_pages(spark):
    out = clean.clean_pages(pages(spark, ["connec-\ntion  of\tx  \n\n\n\n12\n12345\nend", " \n3\n", "z"])).orderBy("page").collect()
    assert [(r.page, r.text) for r in out] == [(1, "connection of x\n\n12345\nend"), (3, "z")]


def paths(spark, *texts):
    return [(r.path, r.text, r.page) for r in sections.split_sections(pages(spark, texts)).orderBy("section_no").collect()]


def test_nested_paths_and_preamble(spark):
    assert paths(spark, "intro\n# A\na\n## B\nb", "more\n# C\n\nc") == [([], "intro", 1), (["A"], "a", 1), (["A", "B"], "b\nmore", 1), (["C"], "c", 2)]


def test_skipped_level_and_empty_bodies(spark):
    assert [p for p, *_ in paths(spark, "## B\nx\n# A\n### C\ny\n## D\nz")] == [["B"], ["A", "C"], ["A", "D"]]


def test_numbering_gives_levels_of_flat_headings(spark):
    found = paths(spark, "## 1 Intro\na\n## 1.1 Part\nb\n## 1.1.2 Deep\nc\n## 2. Next\nd\n## Abstract\ne")
    assert [p for p, *_ in found] == [["1 Intro"], ["1 Intro", "1.1 Part"], ["1 Intro", "1.1 Part", "1.1.2 Deep"], ["2. Next"], ["Abstract"]]


def test_sidebars_stay_in_the_open_section(spark):
    text = "### CHAPTER One\nz\n##### 1.1 What\na\n##### 1.1.1 How\nb\n###### Case <b>History</b>\nc\n##### 1.2 **Why_ it** is\nd"
    found = [p for p, *_ in paths(spark, text)]
    assert found[2] == ["CHAPTER One", "1.1 What", "1.1.1 How"] or found[2][-1] == "1.1.1 How"
    assert found[3][:-1] == found[2] and found[3][-1] == "Case History" and found[4][-1] == "1.2 Why it is"


def test_look_alike_numbers_and_captions(spark):
    found = paths(spark, "# 2019 Results\na\n# 32 bits\nb\n# Figure 3 shows\nc\n## A Human Analogy\nd\n## A.1 Proof\ne")
    assert [p[-1] for p, *_ in found] == ["2019 Results", "32 bits", "A Human Analogy", "A.1 Proof"] and found[1][1] == "b\n# Figure 3 shows\nc"


def test_page_is_that_of_the_first_text(spark):
    assert paths(spark, "# A\n\n", "\nbody") == [(["A"], "body", 2)]


def plain_paths(found):
    """The paths of (hashes, depth, title), one heading after the other, by a stack."""
    numbers = {}
    for hashes, depth, _ in found:
        if depth:
            numbers.setdefault(depth, []).append(hashes)
    usual = {d: max(dict.fromkeys(got), key=got.count) for d, got in numbers.items()}
    shift, deepest = (usual[min(usual)] - min(usual), max(usual)) if usual else (0, 0)
    out, stack = [], []
    for hashes, depth, title in found:
        level = depth or max(1, hashes - shift)
        if not depth and level >= deepest:
            level = max(level, 1 + max((n for n, _, numbered in stack if numbered), default=0))
        stack = [s for s in stack if s[0] < level] + [(level, title, bool(depth))]
        out.append([t for _, t, _ in stack])
    return out


def heading_rows(spark, docs):
    rows = [(doc, k, 1, k, hashes, depth, title) for doc, found in docs.items() for k, (hashes, depth, title) in enumerate(found, 1)]
    return spark.createDataFrame(rows, "doc string, section_no int, page int, line_no int, hashes int, depth int, title string")


@pytest.mark.parametrize("sizes", [(1, 1), (1, 2), (3, 2), (4, 5), (256, 256)])
def test_scanned_paths_equal_a_stack(spark, sizes):
    import random

    rng = random.Random(sum(sizes))
    docs = {f"d{n}": [(rng.randint(1, 6), rng.choice([None, None, 1, 2, 3][: rng.choice([1, 4, 5])]), f"t{k}") for k in range(rng.randint(1, 70))] for n in range(40)}
    got = {(r.doc, r.section_no): r.path for r in sections.heading_paths(heading_rows(spark, docs), *sizes).collect()}
    assert got == {(doc, k): path for doc, found in docs.items() for k, path in enumerate(plain_paths(found), 1)}


def test_paths_of_one_long_document_take_many_tasks(spark):
    n = 60_000
    depth = F.when(F.col("id") % 7 < 4, (F.col("id") % 3 + 1).cast("int"))
    rows = spark.range(1, n + 1, 1, 4).select(F.lit("d").alias("doc"), F.col("id").cast("int").alias("section_no"), F.lit(1).alias("page"), F.col("id").cast("int").alias("line_no"), (F.col("id") % 5 % 6 + 1).cast("int").alias("hashes"), depth.alias("depth"), F.concat(F.lit("t"), "id").alias("title"))
    # As larger tables would be planned: nothing is small enough to be broadcast or put into one task.
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    kept = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        per_task = sections.heading_paths(rows).groupBy(F.spark_partition_id()).count().collect()
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
    assert sum(r["count"] for r in per_task) == n and len(per_task) > 1 and max(r["count"] for r in per_task) < n / 2
    found = [tuple(r) for r in rows.orderBy("section_no").select("hashes", "depth", "title").collect()]
    assert [r.path for r in sections.heading_paths(rows).orderBy("section_no").collect()] == plain_paths(found)


def test_sections_over_ranges_of_pages(spark):
    text = "".join(f"{'#' * (k % 4 + 1)} h{k}\nx{k}\n\n" for k in range(30))
    book = spark.createDataFrame([("d", "d.md", p, f"tail {p}\n" + text) for p in range(9)], schemas.PAGES)
    want, got = ([tuple(r) for r in sections.split_sections(book, *sizes).orderBy("section_no").collect()] for sizes in ((256, 256), (2, 3)))
    assert got == want and len(got) == 271 and got[30][4] == "x29\n\ntail 1"


def packed(spark, text, path=(), **options):
    rows = spark.createDataFrame([("s.md", list(path), text, 4)], "source string, path array<string>, text string, page int")
    return chunk.chunk_sections(rows, **options).orderBy("metadata.part").collect()


def words(n, tag="w"):
    return " ".join(f"{tag}{i}" for i in range(n))


def test_packing_and_ids(spark):
    out = packed(spark, f"{words(10, 'a')}\n\n{words(10, 'b')}\n \n{words(10, 'c')}", ("A", "B"), max_tokens=26, overlap=0, min_tokens=1)
    assert [r.text for r in out] == [f"A > B\n\n{words(10, 'a')}\n\n{words(10, 'b')}", f"A > B\n\n{words(10, 'c')}"]
    import hashlib

    assert out[1].id == hashlib.sha1(f"s.md|A > B|1|{out[1].text}".encode()).hexdigest()[:16] and out[1].metadata.page == 4


def test_overlap_and_minimum(spark):
    out = packed(spark, f"{words(8, 'a')}\n\n{words(3, 'b')}\n\n{words(8, 'c')}\n\n{words(2, 'd')}", max_tokens=11, overlap=3, min_tokens=3)
    assert [r.text.split()[0] for r in out] == ["a0", "b0"] and out[1].text == f"{words(3, 'b')}\n\n{words(8, 'c')}"
    assert [r.metadata.part for r in out] == [0, 1]


@pytest.mark.parametrize("seed", range(6))
def test_packing_equals_a_plain_loop(spark, seed):
    import random

    rng = random.Random(seed)
    paras = [" ".join(words(rng.randint(1, 9), f"p{k}").split()) + rng.choice(["", ". " + words(9, "q") + "! " + words(4, "r"), " " + "x" * 90]) for k in range(25)]
    budget, overlap, n = 12, 4, lambda t: len(t.split())
    units = [u for p in paras for u in ([p] if n(p) <= budget else chunk.split_paragraph(p, budget, n))]
    want, current, size = [], [], 0
    for u in units:
        if current and size + n(u) > budget:
            want.append("\n\n".join(current))
            last = current[-1]
            current, size = ([last], n(last)) if n(last) <= overlap else ([], 0)
        current.append(u)
        size += n(u)
    want.append("\n\n".join(current))
    got = packed(spark, "\n\n".join(paras), max_tokens=budget, overlap=overlap, min_tokens=0)
    assert [r.text for r in got] == want and all(r.n_tokens <= budget + overlap for r in got)


def test_sentences_and_hard_cuts_lose_nothing():
    count = lambda t: len(t) // 3 + 1
    text = "One two. Three four five! " + "z" * 100 + " Six?"
    parts = chunk.split_paragraph(text, 8, count)
    assert "".join("".join(parts).split()) == "".join(text.split()) and all(count(p) <= 8 for p in parts)


def test_long_heading_leaves_a_budget(spark):
    assert packed(spark, "a b c", (words(30),), max_tokens=10, min_tokens=1)[0].text.endswith("\n\na")


def test_vocabulary_counter(spark):
    counter = chunk.VocabularyCounter("/opt/tokenizers/byte_bpe_50k.json")
    out = packed(spark, "\n\n".join(words(20, t) for t in "abc"), counter=counter, max_tokens=70, overlap=0, min_tokens=1)
    n = counter.function()
    assert len(out) > 1 and all(r.n_tokens == n(r.text) <= 70 for r in out)


def test_size_stats(spark):
    assert tuple(chunk.size_stats(spark.createDataFrame([(5,), (1,), (9,), (7,)], "n_tokens int")).first()) == (4, 1, 7, 9)


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.md").write_bytes(b"# T\n\xff\xfebody " + "é".encode())
    (tmp_path / "sub" / "a x.TXT").write_text("plain")
    (tmp_path / "c.png").write_bytes(b"x")
    (tmp_path / "d.log").write_text("one\ftwo")
    rows = {r.source: r for r in files.scan(spark, str(tmp_path)).collect()}
    assert set(rows) == {"b.md", "a x.TXT"} and rows["b.md"].text == "# T\nbody é" and rows["b.md"].page == 1
    parsers = {".log": lambda path, data: enumerate(data.decode().split("\f"), 1)}
    assert [(r.page, r.text) for r in files.scan(spark, str(tmp_path), parsers).where("source = 'd.log'").orderBy("page").collect()] == [(1, "one"), (2, "two")]
    with pytest.raises(ValueError, match="no parser"):
        files.scan(spark, str(tmp_path / "c.png"))


def test_ingest_round_trip(spark, tmp_path):
    text = "# Title\n" + "\n\n".join(words(40, t) for t in "abcd")
    (tmp_path / "x.md").write_text(text)
    chunks = ingest.ingest(spark, str(tmp_path), max_tokens=60)
    records.write(chunks.select("id", "text", "metadata"), f"{tmp_path}/out.jsonl")
    back = records.read_chunks(spark, f"{tmp_path}/out.jsonl")
    assert sorted(r.id for r in back.collect()) == sorted(r.id for r in chunks.collect()) and back.count() == 4
    assert ingest.ingest_text(spark, text, max_tokens=60).first().metadata.source == "user_input"


def test_section_cache(spark, tmp_path):
    (tmp_path / "x.md").write_text("# A\nbody")
    calls = []

    def make(session, path):
        calls.append(path)
        return sections.split_sections(files.scan(session, path))

    for version in ("1", "1", "2"):
        assert records.cached_sections(spark, f"{tmp_path}/x.md", f"{tmp_path}/cache", make, version).first().text == "body"
    assert len(calls) == 2


def test_code_version_follows_the_source(tmp_path, monkeypatch):
    found = []
    for k, body in enumerate(("a = 1", "a = 1", "a = 2")):
        (tmp_path / f"part{k}.py").write_text(body)
        spec = importlib.util.spec_from_file_location(f"part{k}", tmp_path / f"part{k}.py")
        found.append(importlib.util.module_from_spec(spec))
    one, same, other = map(records.code_version, found)
    assert one == same != other and records.code_version(found[0], found[2]) != records.code_version(found[2], found[0])


def test_questions_file(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"query": "one"}\n\n{"query": "two", "type": "factual", "evidence": "e", "relevant": [{"source": "s", "section": "", "page": 2}]}\n')
    rows = records.read_questions(spark, f"{tmp_path}/q.jsonl").orderBy("query_id").collect()
    assert [(r.query_id, r.query, r.type, r.evidence, len(r.relevant)) for r in rows] == [(0, "one", "", "", 0), (1, "two", "factual", "e", 1)]
    assert records.read_questions(spark, f"{tmp_path}/none.jsonl").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_pieces_make_the_chunks_of_their_section(spark, seed):
    """Wherever a section is cut in pieces: passages that begin with a unit of the piece before, span pieces, or end with one. Texts
    are not shuffled, but for those passages."""
    rng = random.Random(seed)
    sections, pieces = [], []
    for d in range(12):
        units = [" ".join(f"d{d}u{i}w{j}" for j in range(rng.choice((1, 2, 3, 5, 9, 40)))) for i in range(rng.randint(1, 60))]
        sections.append((f"s{d}", ["Head"] if d % 2 else [], "\n\n".join(units), 1))
        cuts = sorted({0, len(units), *(rng.randrange(len(units)) for _ in range(rng.choice((0, 1, 4, 30))))})
        pieces += [(f"d{d}", f"s{d}", 1, ["Head"] if d % 2 else [], page, 0, "\n\n".join(units[a:b])) for page, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    whole = chunk.chunk_sections(spark.createDataFrame(sections, "source string, path array<string>, text string, page int"), None, 10, 3, 1)
    cut = spark.createDataFrame(pieces, "doc string, source string, section_no int, path array<string>, page int, k int, text string")
    form = lambda df: sorted(tuple(map(str, r)) for r in df.select("id", "text", "metadata.source", "metadata.section", "metadata.part", "n_tokens").collect())
    made = chunk.chunk_pieces(cut, None, 10, 3, 1)
    assert form(made) == form(whole)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1  # the shares of passages
