import tracemalloc
import zlib

import numpy as np

from findery.llm import language


def grams(text, alphabet):
    row = [int(s) for s in alphabet.symbols(f" {text} ")]
    kept = [s for i, s in enumerate(row) if s or i == 0 or row[i - 1]]
    return {(n, tuple(kept[i : i + n])) for n in language.ORDERS for i in range(len(kept) - n + 1)}


ROWS = [("the cat and the dog were in the garden", "en"), ("what is that thing over there", "en"), ("der hund und die katze im garten", "de"), ("was ist das für ein ding", "de"), ("le chat et le chien sont là", "fr"), ("qu'est-ce que c'est que ça", "fr")]


def test_grams_and_kernel_equal_sets():
    model = language.fit(ROWS)
    made = language.Grams(model.alphabet)
    texts = ["the dog", "  a  ", "ça va, là?", "12 34", "жук the"]
    for t in texts + texts:  # the memory of earlier texts must not show
        assert len(made.of(t)) == len(grams(t, model.alphabet))
    sets = [grams(t, model.alphabet) for t, _ in ROWS]
    kernel = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    targets = np.array([[g == lang for lang in model.languages] for _, g in ROWS], float)
    values, vectors = np.linalg.eigh(kernel)
    root = vectors[:, values > 1e-6 * values.max()] / np.sqrt(values[values > 1e-6 * values.max()])
    z = kernel @ root
    w = np.linalg.solve(z.T @ z / 2 + language.RIDGE * np.eye(z.shape[1]), z.T @ targets / 2)
    assert np.allclose(model.score([made.of(t) for t, _ in ROWS]), z @ w, atol=1e-3)


def test_fit_without_rows():
    assert language.fit([]) is None and language.fit([("12", "en"), ("", "en"), ("a", None)]) is None


def test_query(spark, docs_of, tmp_path):
    rows = [(i, *ROWS[i % 6], "s") for i in range(240)] + [(900, None, "en", "s"), (901, "123 !", "en", "s"), (902, "", None, "s"), (None, "le chien", None, None)]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = language.op6_string_kernel(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (900, 901, 902)) and by[None].lang_pred == "fr" and not by[None].held_out
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(240))
    held = [i for i in range(240) if by[i].held_out]
    assert held and all(by[i].lang_pred == ROWS[i % 6][1] and 0 <= by[i].score <= 1 for i in held)


def test_no_labels(spark, docs_of):
    docs = docs_of([(1, "abc", None, "s")])
    assert language.fit_rows(docs) == []
    assert language.identify(docs, None).first().lang_pred == "und"
    assert language.identify(docs.where("false"), None).count() == 0


def test_held_out_accuracy():
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.01/documents.parquet")
    rows = list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), table["lang"].to_pylist(), strict=True))
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    model = language.fit([(t, g) for i, t, g in rows if not held(i)])
    made = language.Grams(model.alphabet)
    test = [(t, g) for i, t, g in rows if held(i) and language.has_letter(t)]
    best = model.score([made.of(t) for t, _ in test]).argmax(1)
    assert np.mean([model.languages[k] == g for k, (_, g) in zip(best, test, strict=True)]) > 0.97


def test_the_fit_collects_few_rows(spark, monkeypatch):
    """Null and repeated ids, equal rows and long texts."""
    from pyspark.sql.classic.dataframe import DataFrame

    rows = [(None, f"der hund {i}", "de") for i in range(3000)] + [(7, f"the dog {i}", "en") for i in range(2000)] + [(None, "le chat", "fr")] * 3000
    rows += [(i, "una casa " * 100 + str(i), "es") for i in range(60)] + [(None, "uma casa", "pt")] * 3 + [(None, f"uma casa {i} " * 50, "pt") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    seen, collect = [], DataFrame.collect

    def counted(self):
        out = collect(self)
        seen.append(len(out))
        return out

    monkeypatch.setattr(DataFrame, "collect", counted)
    found = language.fit_rows(docs, cap=20, chars=100, long=4)
    per = {g: [t for t, h in found if h == g] for g in ("de", "en", "fr", "es", "pt")}
    assert {g: len(t) for g, t in per.items()} == {"de": 20, "en": 20, "fr": 1, "es": 4, "pt": 5}
    assert max(seen) <= 5 * 24 and per["pt"][0] == "uma casa"
    assert language.fit_rows(docs, cap=20, chars=100, long=4) == found
    assert {g for _, g in language.fit_rows(docs, cap=20, languages=2)} == {"de", "fr"}
    monkeypatch.undo()
    assert language.fit(found, most=5) is not None


def test_scoring_many_languages_is_bounded():
    """64 texts of 17,000 n-grams and 200 languages: scores as by one product, in a fraction of its memory."""
    rng = np.random.default_rng(1)
    vocabulary = np.arange(0, 60_000, 2)
    model = language.Model(None, vocabulary, rng.normal(size=(len(vocabulary), 200)), [str(i) for i in range(200)])
    grams = [np.sort(rng.choice(60_000, 17_000, replace=False)) for _ in range(64)]
    tracemalloc.start()
    found = model.score(grams)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20
    one = grams[7][grams[7] % 2 == 0] // 2
    assert np.allclose(found[7], model.weights[one].sum(0) / np.sqrt(17_000))
