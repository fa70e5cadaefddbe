"""Encoding and decoding by byte pairs with the distinct words of texts in a trie (operator 11).

The BPE of a text is known from the last token of each of its prefixes: it is the BPE of what comes before that token,
and the token. A token can be last if it may stand after the last token of what is before it, and exactly one can. So
the words that are new to a task are put in order, which is the depth-first walk of their trie: the states of the
letters that a word shares with the one before it stay as they are, and only new nodes are computed. Words are known
to a task until their memory is used up; what is forgotten is computed anew, with the same result."""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FOLDER, FILE = "/opt/tokenizers", "word_bpe_49k.json"
END = 0x10000  # added to the last symbol of a word
NEVER = 1 << 30
KNOWN_CHARS = 24_000_000  # of words whose tokens a task keeps, each word counted with 60 more
# Fixed values of the vocabulary's format: how it writes bytes, white space, and its cuts.
PRINTABLE = (*range(33, 127), *range(161, 173), *range(174, 256))
BLANKS = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CUTS = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{BLANKS}\p{{L}}\p{{N}}]+"
#: Blocks whose letters, digits, cases and compositions are old enough to be the same in every version of Unicode.
SETTLED = re.compile(
    "[\x00-\u0530\u0590-\u05f4\u0600-\u06ff\u2000-\u206f\u20a0-\u20bf\u2100-\u23ff\u2500-\u2bff\u3000-\u30ff"
    "\u4e00-\u9fa5\uac00-\ud7a3\U0001f300-\U0001f64f]*"
)
LATIN = "\u024f"  # up to which the cuts are also known as plain ranges
SIGMA = "\u03a3"  # has no other form at the end of a word here


def latin_cuts() -> re.Pattern:
    """CUTS for texts up to LATIN, with ranges in place of properties: some times as fast."""
    of = lambda kind: "".join(c for c in map(chr, range(ord(LATIN) + 1)) if regex.match(kind, c))
    letters, digits = of(r"\p{L}"), of(r"\p{N}")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{BLANKS}{letters}{digits}]+")


def byte_symbols() -> list[str]:
    """The symbol of each byte: printable bytes stand for themselves, the others for code points from 256 on."""
    found, free = [], 256
    for byte in range(256):
        if byte in PRINTABLE:
            found.append(chr(byte))
        else:
            found.append(chr(free))
            free += 1
    return found


class Vocabulary:
    """Tokens by their symbols and the merges that make them, from a tokenizer file of words with an end mark."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model = told["model"]
        mark = model["end_of_word_suffix"]
        names = model["vocab"] | {t["content"]: t["id"] for t in told["added_tokens"]}
        self.names = {i: name for name, i in names.items()}
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        size = max(self.names) + 1
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.pairs: dict[tuple[int, int], int] = {}
        symbols: dict[int, str] = {}
        for s in byte_symbols():
            symbols[names[s]] = s
            symbols[names[s + mark]] = chr(ord(s) + END)
        for rank, pair in enumerate(model["merges"]):
            one, two = pair if isinstance(pair, list) else pair.split(" ")
            x, y, made = names[one], names[two], names[one + two]
            if made in symbols or x not in symbols or y not in symbols:
                raise ValueError(f"a token is made twice, or before its parts: {one} {two}")
            symbols[made] = symbols[x] + symbols[y]
            self.rank[made], self.left[made], self.right[made] = rank, x, y
            self.pairs[x, y] = rank
        self.length = {t: len(s) for t, s in symbols.items()}
        #: Tokens that are the BPE of their own symbols: only these can ever be in a result.
        self.ids = {s: t for t, s in symbols.items() if self.rank[t] < 0 or self.adjoin(self.left[t], self.right[t], self.rank[t])}
        lengths: dict[str, set[int]] = {}
        for s in self.ids:
            lengths.setdefault(s[-1], set()).add(len(s))
        self.lengths = {s: sorted(n, reverse=True) for s, n in lengths.items()}
        self.met: dict[tuple[int, int], bool] = {}

    def adjoin(self, x: int, y: int, limit: int = NEVER) -> bool:
        """Whether BPE leaves x and y side by side, until the merge of the rank limit.

        Their merges are undone, the latest first (of the same rank the right one, as merges go from left to right). At
        each step the symbols at the border were neighbours up to the limit: a merge of them before it crosses the border."""
        rank, pairs = self.rank, self.pairs
        while True:
            if pairs.get((x, y), NEVER) < limit:
                return False
            if rank[x] > rank[y]:
                x, limit = self.right[x], rank[x]
            elif rank[y] >= 0:
                y, limit = self.left[y], rank[y] + 1
            else:
                return True

    def meets(self, x: int, y: int) -> bool:
        found = self.met.get((x, y))
        if found is None:
            if len(self.met) > 1_000_000:
                self.met.clear()
            found = self.met[x, y] = self.adjoin(x, y)
        return found

    def walk(self, words: Iterable[str]) -> dict[str, list[int]]:
        """The tokens of words, which are strings of symbols: a depth-first walk of their trie, a node a shared prefix.

        last has the last token of each prefix on the path from the root."""
        out: dict[str, list[int]] = {}
        before, last = "", [-1]
        ids, lengths, length, met = self.ids, self.lengths, self.length, self.met
        for word in sorted(words):
            shared = common_prefix(before, word)
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for n in lengths[word[end - 1]]:
                    if n > end:
                        continue
                    token = ids.get(word[end - n : end])
                    if token is None:
                        continue
                    if n == end:
                        break
                    ahead = last[end - n]
                    fits = met.get((ahead, token))
                    if fits or (fits is None and self.meets(ahead, token)):
                        break
                last.append(token)
            tokens, end = [], len(word)
            while end:
                tokens.append(last[end])
                end -= length[last[end]]
            out[word] = tokens[::-1]
            before = word
        return out


def common_prefix(a: str, b: str) -> int:
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Codec:
    """Texts to tokens and back, by the vocabulary of a file. Strings of special tokens in a text are these tokens."""

    def __init__(self, path: str, known_chars: int = KNOWN_CHARS):
        from tokenizers import Tokenizer

        self.vocabulary = Vocabulary(path)
        self.library = Tokenizer.from_file(path)  # for its normalizer and its cuts in blocks that aren't settled
        self.cuts, self.latin_cuts, self.latin = regex.compile(CUTS), latin_cuts(), re.compile(f"[\0-{LATIN}]*")
        self.specials = re.compile("|".join(re.escape(s) for s in sorted(self.vocabulary.special, key=len, reverse=True)) or r"(?!)")
        self.symbols = byte_symbols()
        self.room = known_chars
        self.plain: dict[str, bytes] = {s: array("I", [i]).tobytes() for s, i in self.vocabulary.special.items()}
        self.other: dict[str, bytes] = {}
        self.used = 0

    def _words(self, text: str) -> tuple[list[str], bool]:
        """The words of a stretch without special tokens; whether they are as in the text, and not yet symbols of bytes."""
        if SETTLED.fullmatch(text):
            text = text if text.isascii() else unicodedata.normalize("NFC", text).replace(SIGMA, SIGMA.lower())
            text = text.lower()
            return (self.latin_cuts if self.latin.fullmatch(text) else self.cuts).findall(text), True
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [w for w, _ in found], False

    def _stretches(self, text: str) -> list[tuple[list[str], bool]]:
        if "<|" not in text:
            return [self._words(text)]
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [self._words(text[at : m.start()]), ([m.group()], True)]
            at = m.end()
        return [*out, self._words(text[at:])]

    def _learn(self, plain: set[str], other: set[str]) -> None:
        """Adds the tokens of words to those that are known."""
        symbols = self.symbols
        spelled = {w: "".join([symbols[b] for b in w.encode()]) for w in plain}
        ended = lambda s: s[:-1] + chr(ord(s[-1]) + END)
        found = self.vocabulary.walk({ended(s) for s in (*spelled.values(), *other)})
        coded = {s: array("I", t).tobytes() for s, t in found.items()}
        self.plain |= {w: coded[ended(s)] for w, s in spelled.items()}
        self.other |= {w: coded[ended(w)] for w in other}
        self.used += sum(len(w) + 60 for w in (*plain, *other))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as 32-bit integers in the machine's order; null has none."""
        if self.used > self.room:
            self.plain = {s: self.plain[s] for s in self.vocabulary.special}
            self.other, self.used = {}, 0
        cut = [self._stretches(t) if t else [] for t in texts]
        plain, other = set(), set()
        for stretches in cut:
            for words, as_is in stretches:
                (plain if as_is else other).update(words)
        self._learn({w for w in plain if w not in self.plain}, {w for w in other if w not in self.other})
        known = {True: self.plain.__getitem__, False: self.other.__getitem__}
        return [b"".join([x for words, as_is in stretches for x in map(known[as_is], words)]) for stretches in cut]

    def decode(self, ids: Iterable[int]) -> str:
        """The names of tokens, with blanks between, as the file has no decoder; ids without a token are passed over."""
        names = self.vocabulary.names
        return " ".join([names[i] for i in ids if i in names])


def numbers(coded: bytes) -> array:
    found = array("I")
    found.frombytes(coded)
    return found


def little(coded: bytes) -> bytes:
    """ids in the order of little-endian machines."""
    found = numbers(coded)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


def encode(docs: DataFrame, path: str = f"{FOLDER}/{FILE}") -> DataFrame:
    """docs with ids, the tokens of text; null and empty texts have none. The file must be on every executor."""

    def make():
        codec = Codec(path)
        return lambda texts: [[numbers(ids).tolist() for ids in codec.encode(texts)]]

    return common.map_columns(docs, ["text"], make, "ids array<int>")


def decode(rows: DataFrame, path: str = f"{FOLDER}/{FILE}") -> DataFrame:
    """rows with decoded, the text of ids; null ids have a null text, null items and ids without a token are passed over."""

    def make():
        codec = Codec(path)
        return lambda lists: [[None if ids is None else codec.decode(ids) for ids in lists]]

    return common.map_columns(rows, ["ids"], make, "decoded string")


def digests(docs: DataFrame, path: str = f"{FOLDER}/{FILE}") -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256: encoded, decoded again and hashed in one pass."""

    def make():
        codec = Codec(path)

        def step(texts):
            coded = codec.encode(texts)
            sha = lambda x: hashlib.sha256(x).hexdigest()
            return [
                [len(c) // 4 for c in coded],
                [sha(little(c)) for c in coded],
                [sha(codec.decode(numbers(c)).encode()) for c in coded],
            ]

        return step

    return common.map_columns(docs, ["text"], make, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: doc_id, n_tokens, ids_sha256, decoded_sha256. A null text counts as an empty one; rows
    with the same doc_id stay apart; other columns aren't read."""
    docs = common.load(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("text"))
    return digests(docs).drop("text")
