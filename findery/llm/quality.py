"""Quality rules: distribution divergence of a text from the references of the languages (operator 5).

References are two histograms a language, over all documents that name it and pass the base rules: character
classes, and common words without case and signs around them. A document is compared with the reference of its own language, or with the nearest
one of its script if it names no language, by the Jensen-Shannon distance (base 2, 0 to 1). Documents of a language
without reference aren't judged by distances."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WORDS = re.compile(common.SPACE_WORD)
SYMBOLS = "#*$%&|<>"
WINDOW = 8
BLANKS = " \t\n\v\f\r"
AROUND_WORDS = ".,;:!?\"'()[]{}<>*_-\u2013\u2014\u2018\u2019\u201c\u201d\u201e\u00ab\u00bb\u2026\u00a1\u00bf"
CACHED_WORDS = 200_000
CLASSES = ("lower", "upper", "other_letter", "mark", "digit", "space", "stop", "quote_dash", "symbol", "control")
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: What str.split takes for white space besides ASCII white space.
OTHER_GAPS = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

#: Parameters of production.
COMMON_WORDS = 64  # of each language, the most frequent ones
MIN_REFERENCE_WORDS = 2_000  # a language with fewer words gets no reference
MIN_CHARS = 200  # shorter texts aren't judged by character classes
MIN_WORDS = 80  # nor by common words
MAX_CHAR_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.48  # at most; see word_limit
#: Common words that a text of its length should hold, and the part of the distance of a text with none that is allowed.
EXPECTED, ALLOWED = (24, 90, 150), (0.98, 0.80, 0.72)
MIN_EXPECTED = 20  # where the reference leads to fewer, nothing follows from their absence
FLUSH_WORDS = 100_000  # distinct words that a task counts before it passes them on


def char_class(point: int) -> int:
    kind = unicodedata.category(chr(point))
    if kind == "Ll":
        return 0
    if kind in ("Lu", "Lt"):
        return 1
    if kind[0] == "L":
        return 2
    if kind[0] == "M":
        return 3
    if kind[0] == "N":
        return 4
    if chr(point).isspace():
        return 5
    if chr(point) in ".,;:!?":
        return 6
    if kind in ("Pd", "Pi", "Pf", "Ps", "Pe") or chr(point) in "'\"":
        return 7
    return 8 if kind[0] in "PS" else 9


_TABLE = np.array([char_class(i) if not 0xD800 <= i < 0xE000 else 9 for i in range(0x3000)], np.uint8)


def class_counts(text: str) -> np.ndarray:
    """Characters of text by class; those beyond the table are looked up one distinct character at a time."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    near = points < len(_TABLE)
    counts = np.bincount(_TABLE[points[near]], minlength=len(CLASSES))
    if not near.all():
        far, n = np.unique(points[~near], return_counts=True)
        for point, k in zip(far.tolist(), n.tolist(), strict=True):
            counts[9 if 0xD800 <= point < 0xE000 else char_class(point)] += k
    return counts


@lru_cache(1 << 16)
def script_of(char: str) -> str:
    """The script of a letter as the first word of its Unicode name; empty for other characters."""
    return re.split("[ -]", unicodedata.name(char, ""))[0] if char.isalpha() else ""


def script(counts: Counter) -> str:
    """The script of most letters, the first by name of equal ones; empty without letters."""
    seen: Counter = Counter()
    for char, n in counts.items():
        seen[script_of(char)] += n
    del seen[""]
    return min(seen, key=lambda k: (-seen[k], k), default="")


def window_hashes(words: list[str], width: int) -> np.ndarray:
    """A hash for each window of so many words, from those of windows half as wide. They agree in one process only."""
    row = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key, have = row, 1
    while have < width:
        more = have if 2 * have <= width else 1
        other = key if more > 1 or have == 1 else row
        n = len(words) - have - more + 1
        key = key[:n] * FACTOR + other[have : have + n]
        key ^= key >> np.uint64(29)
        have += more
    return key


def repeated_window_words(words: list[str], width: int = WINDOW) -> int:
    """Words inside any window of so many words that occurs twice or more in the list, all occurrences counted."""
    if len(words) <= width:
        return 0
    if width > 1 and len(set(words)) >= len(words) - 1:
        return 0  # two equal windows of two or more words would repeat two words at least
    key = window_hashes(words, width)
    ordered = np.sort(key)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(again):
        return 0
    candidates = np.flatnonzero(again[np.minimum(np.searchsorted(again, key), len(again) - 1)] == key)
    exact = Counter(tuple(words[i : i + width]) for i in candidates.tolist())  # hashes only propose
    hit = np.zeros(len(words) + 1, np.int64)
    for i in candidates.tolist():
        if exact[tuple(words[i : i + width])] > 1:
            hit[i] += 1
            hit[i + width] -= 1
    return int((np.cumsum(hit)[:-1] > 0).sum())


def split_words(text: str) -> list[str]:
    """Runs without ASCII white space; str.split is faster where the text has no other characters that it splits at."""
    return WORDS.findall(text) if OTHER_GAPS.search(text) else text.split()


def base_rules(text: str | None) -> tuple[list[str], int, int, int, int, bool]:
    """words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of a whole text."""
    text = text or ""
    words = split_words(text)
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    repeat = repeated_window_words(words)
    failed = len(words) < 20 or 100 * repeat > 30 * len(words)
    return words, sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat, failed


def folded(word: str) -> str:
    """A word without case and the signs around it; a word of signs alone stays."""
    return word.strip(AROUND_WORDS).casefold() or word


class Places:
    """Common words, in all forms in which texts have them, by their place in the histogram of their folded forms."""

    def __init__(self, known: dict[str, int]):
        self.known, self.seen, self.places = known, set(), {}

    def histogram(self, words: list[str]) -> np.ndarray:
        counts = Counter(words)
        if len(self.seen) > CACHED_WORDS:
            self.seen.clear()
            self.places.clear()
        new = counts.keys() - self.seen
        self.seen |= new
        self.places |= {w: self.known[f] for w in new if (f := folded(w)) in self.known}
        found = np.zeros(len(self.known) + 1)
        for word in counts.keys() & self.places.keys():
            found[self.places[word]] += counts[word]
        found[-1] = len(words) - found.sum()
        return found


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms: the root of the divergence in bits; 0 if either is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    kl = lambda a: float((a[a > 0] * np.log2(a[a > 0] / m[a > 0])).sum())
    return math.sqrt(max(0.0, (kl(p) + kl(q)) / 2))


def word_limit(n_words: int, reference: np.ndarray, most: float = MAX_WORD_DISTANCE) -> float:
    """The largest word distance that a text of so many words may have from a histogram of common words and the rest.

    It stays below the distance of a text without any common word, and falls with the number that one should hold,
    as chance then moves its histogram less. A reference whose common words are too rare for the text sets none."""
    share = 1 - reference[-1] / reference.sum()
    if n_words * share < MIN_EXPECTED:
        return math.inf
    none = np.append(np.zeros(len(reference) - 1), 1)
    return min(most, js_distance(none, reference) * float(np.interp(n_words * share, EXPECTED, ALLOWED)))


def references(docs: DataFrame, common_words: int = COMMON_WORDS, min_words: int = MIN_REFERENCE_WORDS) -> dict[str, tuple[np.ndarray, dict[str, int], np.ndarray]]:
    """lang -> (class histogram, common word -> place, histogram of those words and the rest).

    Counts come from all documents with a lang that pass the base rules. Tasks add up words before they pass
    them on; only the most frequent words of each language reach the driver, and there are few languages."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("item", T.StringType()), T.StructField("n", T.LongType())])

    def count(batches):
        import pyarrow as pa

        by_lang: dict[str, tuple[Counter, np.ndarray]] = {}

        def rows():
            kept: Counter = Counter()
            for lang, (seen, classes) in by_lang.items():
                for word, n in seen.items():
                    kept[lang, "word", folded(word)] += n
                kept[lang, "words", ""] += seen.total()
                for k, n in enumerate(classes.tolist()):
                    kept[lang, "class", str(k)] += n
            by_lang.clear()
            keys = list(kept)
            return pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.string()) for i in range(3)] + [pa.array([kept[k] for k in keys], pa.int64())], names=["lang", "kind", "item", "n"])

        for whole in batches:
            for at in range(0, whole.num_rows, common.ROWS_PER_SLICE):
                part = whole.slice(at, common.ROWS_PER_SLICE)
                for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words, *_, failed = base_rules(text)
                    if not failed:
                        seen, classes = by_lang.setdefault(lang, (Counter(), np.zeros(len(CLASSES), np.int64)))
                        seen.update(words)
                        classes += class_counts(text)
                if sum(len(seen) for seen, _ in by_lang.values()) > FLUSH_WORDS:
                    yield rows()
        if by_lang:
            yield rows()

    common.small_batches(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    totals = common.stage(known.mapInArrow(count, schema).groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")), "histograms")
    wide = totals.where("kind <> 'word'").collect()  # a dozen rows a language
    size = {r.lang: r.n for r in wide if r.kind == "words" and r.n >= min_words}
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "item")
    ranked = totals.where((F.col("kind") == "word") & F.col("lang").isin(list(size))).withColumn("k", F.row_number().over(best)).where(F.col("k") <= common_words)
    words = sorted(ranked.collect(), key=lambda r: r.k)  # Spark cuts each task to so many words a language
    out = {}
    for lang, n_words in sorted(size.items()):
        top = [r for r in words if r.lang == lang]
        classes = np.zeros(len(CLASSES))
        for r in wide:
            if r.kind == "class" and r.lang == lang:
                classes[int(r.item)] = r.n
        histogram = np.array([*(r.n for r in top), n_words - sum(r.n for r in top)], float)
        out[lang] = classes, {r.item: i for i, r in enumerate(top)}, histogram
    return out


def assess(docs: DataFrame, refs: dict, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS, max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """docs with the base figures, char_distance, word_distance, compared_lang, kept.

    Null, empty or blank texts have no words and fail the base rules. A distance is null where the text is under
    its guard, its language has no reference, or it names no language and has letters of a script that no reference
    has; a null distance doesn't reject. Added columns replace columns of their names."""

    scripts = {}
    for name, (_, places, histogram) in refs.items():
        letters: Counter = Counter()
        for word, k in places.items():
            for char in word:
                letters[char] += int(histogram[k])
        scripts[name] = script(letters)

    def distances(text, words, lang, common_places):
        if lang is not None:
            own = {lang: refs[lang]} if lang in refs else {}
        else:
            letters = script(Counter(text))
            own = {k: v for k, v in refs.items() if letters in ("", scripts[k])}
        classes = class_counts(text) if len(text) >= min_chars else None
        best = (None, None, None)
        for name, (ref_classes, _, ref_words) in own.items():
            char = js_distance(classes, ref_classes) if classes is not None else None
            word = None
            if len(words) >= min_words:
                word = js_distance(common_places[name].histogram(words), ref_words)
            if best[2] is None or (char or 0) + (word or 0) < (best[0] or 0) + (best[1] or 0):
                best = (char, word, name)
        return best

    def make():
        common_places = {name: Places(places) for name, (_, places, _) in refs.items()}

        def step(texts, langs):
            out = [[] for _ in range(10)]
            for text, lang in zip(texts, langs, strict=True):
                words, *base, failed = base_rules(text)
                char, word, name = (None, None, None) if failed else distances(text, words, lang, common_places)
                kept = not failed and (char is None or char <= max_char) and (word is None or word <= word_limit(len(words), refs[name][2], max_word))
                for column, value in zip(out, (len(words), *base, failed, kept, char, word, name), strict=True):
                    column.append(value)
            return out

        return step

    adds = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double, compared_lang string"
    return common.map_columns(docs, ["text", "lang"], make, adds)


def op5_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, the base figures, kept, and the distances that it follows from."""
    docs = common.load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return assess(docs, references(docs)).drop("text", "lang")
