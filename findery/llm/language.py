"""Language identification by string kernels (operator 6).

The kernel of two texts is the number of distinct character n-grams (n = 1 to 4) that both have, divided by the
root of the product of how many each has: a blended-spectrum presence kernel. Nystrom landmarks span the feature
space; a kernel ridge regression for each language against the rest is fitted there. Scoring a batch is a product
of its presence rows with the landmarks' rows and then with the weights; both factors are multiplied once after the
fit, since the norm of a text is a factor of its row alone.

The fit takes a bounded sample of labelled rows: at most FIT_ROWS a language, of texts of up to FIT_CHARS characters (a
language with fewer such texts adds up to FIT_LONG longer ones), of the MAX_LANGUAGES languages with the most rows. Other
languages aren't learned. Every text is scored as a whole."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Parameters of production. The first five bound what the driver collects and fits.
FIT_ROWS = 160
FIT_CHARS = 20_000
FIT_LONG = 4
MAX_LANGUAGES = 200
MAX_LANDMARKS = 2_400  # of all languages
LANDMARKS = 48  # of one
ORDERS = (1, 2, 3, 4)
RIDGE = 1e-3
SYMBOLS = 61  # of the alphabet, besides the blank (0) and two for letters and for signs outside it
BITS = 6
UNKNOWN = "und"
BLOCK = 1 << 16  # characters that a step looks at; n-grams of all blocks are joined


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Alphabet:
    """Characters as 6-bit symbols: the blank for all but letters, the most frequent letters, others as one."""

    def __init__(self, texts: list[str]):
        seen: dict[str, int] = {}
        for text in texts:
            for c in text.lower():
                if c.isalpha():
                    seen[c] = seen.get(c, 0) + 1
        top = sorted(seen, key=lambda c: (-seen[c], c))[:SYMBOLS]
        self.table = np.zeros(0x11_0000, np.uint8)
        for c, k in zip(sorted(top), range(2, SYMBOLS + 2), strict=False):
            for form in {c, c.upper(), c.title()}:
                if len(form) == 1:
                    self.table[ord(form)] = k
        self.other = SYMBOLS + 2

    def symbols(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        row = self.table[points].astype(np.uint32)
        far = np.flatnonzero((row == 0) & (points > 0x7F))
        if len(far):
            letters = np.array([chr(p).isalpha() for p in points[far].tolist()])
            row[far[letters]] = self.other
        return row


class Grams:
    """Distinct n-grams of texts as codes; the memory of the last places makes it one pass without sorting."""

    def __init__(self, alphabet: Alphabet):
        self.alphabet = alphabet
        self.place = {n: np.full(1 << (BITS * n), -1, np.int32) for n in ORDERS}

    def of(self, text: str) -> np.ndarray:
        row = self.alphabet.symbols(f" {text} ")
        row = row[np.flatnonzero((row != 0) | np.append(True, row[:-1] != 0))]  # one blank for many
        found = []
        code = np.zeros(len(row), np.uint32)
        for n in ORDERS:
            if len(row) < n:
                break
            code = row if n == 1 else (code[: len(row) - n + 1] << np.uint32(BITS)) | row[n - 1 :]
            place, at = self.place[n], np.arange(len(code), dtype=np.int32)
            place[code] = at
            found.append(code[place[code] == at].astype(np.int64) + (n << 32))
        return np.concatenate(found)


SCORE_CELLS = 8_000_000  # weights that are gathered for a batch at a time: 64 MB


class Model:
    """weights: one column a language, over the n-grams of the landmarks, kept sorted."""

    def __init__(self, alphabet: Alphabet, vocabulary: np.ndarray, weights: np.ndarray, languages: list[str]):
        self.alphabet, self.vocabulary, self.weights, self.languages = alphabet, vocabulary, weights, languages

    def score(self, grams: list[np.ndarray]) -> np.ndarray:
        """Ridge scores of a batch: rows are texts, columns languages, so many of which are gathered at a time that no more
        than SCORE_CELLS weights are (or one of each n-gram of the batch)."""
        sizes = np.array([len(g) for g in grams])
        codes = np.concatenate(grams)
        at = np.minimum(np.searchsorted(self.vocabulary, codes), len(self.vocabulary) - 1)
        found = self.vocabulary[at] == codes
        owner, at = np.repeat(np.arange(len(grams), dtype=np.int32), sizes)[found], at[found]
        out = np.empty((len(grams), len(self.languages)))
        step = max(1, SCORE_CELLS // max(1, len(at)))
        for first in range(0, len(self.languages), step):
            rows = self.weights[:, first : first + step][at]
            for k in range(rows.shape[1]):
                out[:, first + k] = np.bincount(owner, rows[:, k], len(grams))
        return out / np.sqrt(np.maximum(sizes, 1))[:, None]


def kernels(sets: list[np.ndarray], chosen: list[np.ndarray]) -> np.ndarray:
    """The kernel of each set with each chosen one, by lists of the sets that have an n-gram."""
    sizes = [len(c) for c in chosen]
    codes, owner = np.concatenate(chosen), np.repeat(np.arange(len(chosen)), sizes)
    order = np.argsort(codes, kind="stable")
    codes, owner = codes[order], owner[order]
    out = np.zeros((len(sets), len(chosen)))
    for row, own in zip(out, sets, strict=True):
        low, n = np.searchsorted(codes, own, "left"), np.searchsorted(codes, own, "right")
        n -= low
        places = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        row += np.bincount(owner[places], minlength=len(chosen)) / np.sqrt(len(own) * np.array(sizes))
    return out


def fit(rows: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE, most: int = MAX_LANDMARKS) -> Model | None:
    """rows: (text, lang) in a fixed order; the first ones of each language are its landmarks."""
    rows = [(t, g) for t, g in rows if t and g is not None and has_letter(t)]
    if not rows:
        return None
    languages = sorted({g for _, g in rows})
    alphabet = Alphabet([t for t, _ in rows])
    grams = Grams(alphabet)
    sets = [grams.of(t) for t, _ in rows]
    chosen, per = [], dict.fromkeys(languages, 0)
    for i, (_, g) in enumerate(rows):
        if per[g] < max(1, min(landmarks, most // len(languages))):
            per[g] += 1
            chosen.append(i)
    marks = [sets[i] for i in chosen]
    kernel = kernels(sets, marks)  # texts by landmarks
    values, vectors = np.linalg.eigh(kernel[chosen])
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])  # Nystrom features are kernel @ root
    features = kernel @ root
    targets = np.array([[1.0 if g == lang else 0.0 for lang in languages] for _, g in rows])
    number = Counter(g for _, g in rows)
    balance = np.array([1 / number[g] for _, g in rows])[:, None]
    gram = features.T @ (features * balance) + ridge * np.eye(features.shape[1])
    parts = root @ np.linalg.solve(gram, features.T @ (targets * balance)) / np.sqrt([len(m) for m in marks])[:, None]
    vocabulary, place = np.unique(np.concatenate(marks), return_inverse=True)
    owner = np.repeat(np.arange(len(marks)), [len(m) for m in marks])
    weights = np.stack([np.bincount(place, parts[owner, k], len(vocabulary)) for k in range(len(languages))], 1)
    return Model(alphabet, vocabulary, weights, languages)


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))


def fit_rows(docs: DataFrame, cap: int = FIT_ROWS, languages: int = MAX_LANGUAGES, chars: int = FIT_CHARS, long: int = FIT_LONG) -> list[tuple[str, str]]:
    """At most cap labelled rows of each of the most frequent languages, by a hash of doc_id and text, so null and
    repeated ids don't matter; rows that agree in both count once. Texts of up to chars characters come first, and no
    more than long others.

    Numbers of different hashes (estimates, taken twice over) set the share of them that is read, so no group is
    gathered; the driver gets cap rows a language."""
    spread = 1 << 30
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("text", "lang", F.pmod(F.xxhash64("doc_id", "text"), F.lit(spread)).alias("__h"), (F.length("text") > chars).alias("__long"))
    different = lambda long: F.approx_count_distinct(F.when(F.col("__long") == long, F.col("__h")))
    counts = known.groupBy("lang").agg(F.count("*").alias("n"), different(False).alias("n_short"), different(True).alias("n_long")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    if not counts:
        return []
    share = lambda most, n: min(spread, 1 + 2 * most * spread // max(1, n))
    limits = known.sparkSession.createDataFrame([(r.lang, share(cap, r.n_short), share(long, r.n_long)) for r in counts], "lang string, __short long, __far long")
    hashed = known.join(F.broadcast(limits), "lang")
    hashed = hashed.where(F.col("__h") < F.when(F.col("__long"), F.col("__far")).otherwise(F.col("__short")))
    hashed = hashed.groupBy("lang", "__long", "__h").agg(F.min("text").alias("text"))
    first = Window.partitionBy("lang", "__long").orderBy("__h")
    rows = hashed.withColumn("__k", F.row_number().over(first)).where(F.col("__k") <= F.when(F.col("__long"), long).otherwise(cap))
    out, per = [], Counter()
    for r in sorted(rows.collect(), key=lambda r: (r["__long"], r["__h"], r.lang)):
        per[r.lang] += 1
        if per[r.lang] <= cap:
            out.append((r.text, r.lang))
    return out


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred and score (0 to 1): und and 0 for null texts and those without a letter, or without a
    model. Ties go to the first language by name. Added columns replace those of the same names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the rows of the fit

    def make():
        own = shared.value
        grams = Grams(own.alphabet) if own else None

        def step(texts):
            names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            at = [i for i, t in enumerate(texts) if own and t and has_letter(t)]
            if at:
                found = own.score([grams.of(texts[i]) for i in at])
                best = found.argmax(1)
                for i, k, row in zip(at, best.tolist(), found, strict=True):
                    names[i], scores[i] = own.languages[k], float(min(1.0, max(0.0, row[k])))
            return [names, scores]

        return step

    return common.map_columns(docs, ["text"], make, "lang_pred string, score double")


def op6_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, held_out, lang_pred, score; fitted on labelled rows that aren't held out."""
    docs = common.load(spark, sf_dir, "documents")
    model = fit(fit_rows(docs.select("doc_id", "text", "lang")))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
