import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from findery.llm import quality


def brute_repeats(words, width=8):
    windows = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]
    times = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(width)})


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=60))
def test_repeated_windows(words):
    assert quality.repeated_window_words(words) == brute_repeats(words)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=120))
def test_class_counts_cover_the_text(text):
    counts = quality.class_counts(text)
    assert counts.sum() == len(text)
    assert counts.tolist() == np.bincount([quality.char_class(ord(c)) for c in text], minlength=10).tolist() if text else True


def test_base_rules():
    words, chars, symbols, lines, repeats, failed = quality.base_rules("a b#\n\na b#\n $c\x0b\x85d\u2003e")
    assert words == ["a", "b#", "a", "b#", "$c", "\x85d\u2003e"] and (chars, symbols, lines, repeats, failed) == (12, 3, 1, 0, True)
    assert quality.base_rules(None)[1:] == (0, 0, 0, 0, True)
    assert quality.base_rules(" ".join(map(str, range(20))))[5] is False
    phrase = " ".join(map(str, range(10)))
    assert quality.base_rules(f"{phrase} {phrase} x y z")[4:] == (20, True)


def test_distance():
    assert quality.js_distance(np.array([1.0, 0]), np.array([0, 3.0])) == 1
    assert quality.js_distance(np.array([1.0, 1]), np.array([2.0, 2])) == 0
    assert quality.js_distance(np.zeros(2), np.ones(2)) == 0


def prose(seed, n=120):
    rng = random.Random(seed)
    common = ["the", "of", "and", "to", "in", "that"]
    return " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choices("aeinorstl", k=7)) for _ in range(n)) + "."


def test_junk_goes_and_prose_stays(docs_of):
    rows = [(i, prose(i), "xx", "s") for i in range(60)]
    junk = [(100, " ".join(f"{w}!!$$" for w in prose(7).upper().split()), "xx", "s"), (101, "| # " * 200, "xx", "s"), (102, None, "xx", "s"), (103, "", None, "s"), (104, "short", "xx", "s"), (105, prose(3), None, "s"), (105, prose(3), None, "s"), (106, prose(5), "unknown", None)]
    docs = docs_of(rows + junk)
    refs = quality.references(docs)
    assert set(refs) == {"xx"}
    out = quality.assess(docs, refs)
    kept = {r.doc_id: r.kept for r in out.select("doc_id", "kept").collect()}
    assert all(kept[i] for i in range(60)) and kept[105] and kept[106] and not any(kept[i] for i in range(100, 105))
    assert out.count() == len(rows + junk)


def test_guards_and_no_reference(docs_of):
    docs = docs_of([(1, " ".join("$#" * 3 for _ in range(25)), None, "s"), (2, prose(1), "aa", "s")])
    assert quality.references(docs) == {}
    assert {r.doc_id: r.kept for r in quality.assess(docs, {}).collect()} == {1: False, 2: True}  # the first repeats itself
    assert quality.references(docs.where("false")) == {} and quality.assess(docs.where("false"), {}).count() == 0


def spoken(seed, n, common):
    """Words of which three in ten are common ones, as in languages at hand."""
    rng = random.Random(seed)
    return " ".join(rng.choice(common) if rng.random() < 0.3 else "".join(rng.choices("aeinorstl", k=rng.randint(4, 9))) for _ in range(n)) + "."


def test_texts_without_common_words_go(docs_of):
    rng = random.Random(1)
    speech = {lang: ["".join(rng.choices("aeinorstlhdu", k=3)) for _ in range(40)] for lang in ("aa", "bb")}
    clean = [(i, spoken(i, 80 + 5 * i, speech[lang]), lang, "s") for i in range(80) for lang in speech]
    gibberish = [(1000 + n, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(n)), "aa", "s") for n in (80, 150, 500, 5000)]
    mislabelled = [(2000 + n, spoken(n, n, speech["bb"]), "aa", "s") for n in (80, 150, 500, 5000)]
    refs = quality.references(docs_of(clean))
    kept = {r.doc_id: r.kept for r in quality.assess(docs_of(clean + gibberish + mislabelled), refs).select("doc_id", "kept").collect()}
    assert [i for i, *_ in gibberish + mislabelled if kept[i]] == []
    assert [i for i, *_ in clean if not kept[i]] == []


def test_word_limit():
    usual = np.array([*[10.0] * 30, 700.0])
    none = quality.js_distance(np.append(np.zeros(30), 1), usual)
    limits = [quality.word_limit(n, usual) for n in (80, 150, 500, 10_000)]
    assert limits == sorted(limits, reverse=True) and limits[0] < none < quality.MAX_WORD_DISTANCE and limits[2] == limits[3] > 0.7 * none
    assert quality.word_limit(100, np.array([1.0, 99.0])) == np.inf  # one common word expected: none is no sign
    assert quality.word_limit(100, np.array([90.0, 10.0])) == quality.MAX_WORD_DISTANCE


def test_only_references_of_the_language_or_script_judge(docs_of):
    rng = random.Random(2)
    hebrew = lambda n: " ".join("".join(rng.choices("אבגדהוזחטילמנ", k=rng.randint(2, 7))) for _ in range(n))
    rows = [(i, prose(i), "xx", "s") for i in range(60)]
    signs = " ".join("".join(rng.choices("#*$%&|<>", k=5)) for _ in range(120))
    rare = [(100, hebrew(150), "he", "s"), (101, hebrew(150), None, "s"), (102, prose(3), None, "s"), (103, signs, None, "s"), (104, signs, "xx", "s")]
    docs = docs_of(rows + rare)
    refs = quality.references(docs)
    assert set(refs) == {"xx"}
    out = {r.doc_id: r for r in quality.assess(docs, refs).collect()}
    for i in (100, 101):
        assert out[i].kept and (out[i].char_distance, out[i].word_distance, out[i].compared_lang) == (None, None, None)
    assert out[102].kept and out[102].compared_lang == "xx" and not out[103].kept and not out[104].kept


def test_scripts():
    assert [quality.script(Counter(t)) for t in ("abc ж", "Ёж ab жж", "1, 2!", "漢字 a", "ひ a", "")] == ["LATIN", "CYRILLIC", "", "CJK", "HIRAGANA", ""]


def plain(rows):
    """The query in plain Python: rows (doc_id, text, lang) -> the columns of each row."""
    import math
    import unicodedata
    from collections import Counter

    def base(text):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        n = Counter(windows)
        inside = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(8)}
        failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
        return words, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), sum(lines[i] in lines[:i] for i in range(len(lines))), len(inside), failed

    def fold(word):
        return word.strip(quality.AROUND_WORDS).casefold() or word

    def classes(text):
        seen = [0] * len(quality.CLASSES)
        for c in text:
            seen[quality.char_class(ord(c))] += 1
        return seen

    def distance(p, q):
        if not sum(p) or not sum(q):
            return 0.0
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        half = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b, strict=True) if x)
        return math.sqrt(max(0.0, (half(p, q) + half(q, p)) / 2))

    refs = {}
    for lang in {g for _, _, g in rows if g is not None}:
        texts = [t for _, t, g in rows if g == lang and t is not None and not base(t)[-1]]
        n = Counter(fold(w) for t in texts for w in base(t)[0])
        if n.total() >= quality.MIN_REFERENCE_WORDS:
            top = sorted(n, key=lambda w: (-n[w], w))[: quality.COMMON_WORDS]
            refs[lang] = [sum(k) for k in zip(*map(classes, texts), strict=True)], top, [*(n[w] for w in top), n.total() - sum(n[w] for w in top)]

    def script(pairs):
        n = Counter()
        for c, k in pairs:
            if c.isalpha():
                n[re.split("[ -]", unicodedata.name(c, ""))[0]] += k
        return min(n, key=lambda k: (-n[k], k), default="")

    out = []
    for i, text, lang in rows:
        words, *rest, failed = base(text)
        best = (None, None, None)
        if not failed:
            own = [lang] if lang is not None else [g for g, r in refs.items() if script((c, 1) for c in text) in ("", script((c, k) for w, k in zip(r[1], r[2], strict=False) for c in w))]
            found = []
            for g in own:
                if g in refs:
                    char = distance(classes(text), refs[g][0]) if len(text) >= quality.MIN_CHARS else None
                    n = Counter(fold(w) for w in words)
                    seen = [n[w] for w in refs[g][1]]
                    word = distance([*seen, len(words) - sum(seen)], refs[g][2]) if len(words) >= quality.MIN_WORDS else None
                    found.append(((char or 0) + (word or 0), g, char, word))
            if found:
                _, g, char, word = min(found)
                best = char, word, g
        char, word, g = best
        kept = not failed and (char is None or char <= quality.MAX_CHAR_DISTANCE) and (word is None or word <= quality.word_limit(len(words), np.array(refs[g][2], float)))
        out.append((str(i), len(words), *rest, failed, kept, g, *(None if x is None else round(x, 9) for x in (char, word))))
    return sorted(out, key=str)


def test_the_query_against_plain_python(spark, docs_of, tmp_path):
    rng = random.Random(11)
    vocabulary = {g: ["".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(150)] for g, letters in (("aa", "abcdefgh"), ("bb", "mnopqrst"), ("ru", "жзийклмн"))}

    def prose(g, n):
        weights = [1 / (k + 1) for k in range(150)]
        words = [w.title() if rng.random() < 0.1 else w for w in rng.choices(vocabulary[g], weights, k=n)]
        return "".join(w + rng.choice([" ", " ", " ", ", ", ".\n", " (", "! "]) for w in words)

    rows = [(i, prose(g, rng.choice([10, 30, 90, 200, 400])), g) for i, g in enumerate(["aa", "bb", "ru"] * 14)]
    rows += [(100, prose("aa", 300), None), (101, prose("ru", 300), None), (102, prose("aa", 300), "bb"), (103, "| # * " * 100, "aa"), (104, prose("bb", 40) * 3, "bb"), (105, "same line here\n" * 12 + prose("aa", 100), "aa")]
    rows += [(106, "".join(rng.choices("qwertzuiop ", k=2000)), "aa"), (107, None, "aa"), (108, "", None), (None, " \t\n", "zz"), (109, prose("aa", 120), "zz"), (109, prose("aa", 120), "zz"), (110, "中文 " * 100, None), (111, "- — !? " * 60, None)]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = quality.op5_distribution_divergence(spark, str(tmp_path)).collect()
    shown = lambda x: None if x is None else round(x, 9)
    made = [(str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.compared_lang, shown(r.char_distance), shown(r.word_distance)) for r in got]
    assert sorted(made, key=str) == plain(rows)
    assert {r.kept for r in got if not r.base_failed} == {True, False}
