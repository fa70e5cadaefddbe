import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from findery.llm import bpe

PATH = f"{bpe.FOLDER}/{bpe.FILE}"


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(PATH)


def same(codec, text):
    ids = bpe.numbers(codec.encode([text])[0]).tolist()
    theirs = codec.library.encode(text, add_special_tokens=False).ids
    return ids == theirs and codec.decode(ids) == codec.library.decode(theirs, skip_special_tokens=False)


PIECES = ["ab", "hahaha", "aaaa", "the ", "'s", "'", "<|endoftext|>", "<|startoftext|>", "<|", "1", "23", " ", "\n", "\x1c", " ", "\xa0", "é", "é", "ß", "İ", "Σ", "ΑΣ ", "\U0001f602\U0001f602", "中文", "’", "—", "Ᲊ", "ﬁ", "====", "----", "....", "HELLO", "lolol", "ing", "a", "e", "s", "t"]


def test_random_texts_equal_the_library(codec):
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choices(PIECES, k=rng.randint(0, 30)))
        assert same(codec, text), text
        text = "".join(rng.choices("aehilnorst"[: rng.randint(1, 10)], k=rng.randint(1, 60)))
        assert same(codec, text), text


def test_settled_blocks_are_cut_as_the_library_does(codec):
    for c in map(chr, range(0x3100)):
        if bpe.SETTLED.fullmatch(c):
            words, as_is = codec._words(f"a{c}!")
            theirs = codec.library.pre_tokenizer.pre_tokenize_str(codec.library.normalizer.normalize_str(f"a{c}!"))
            assert as_is and [t for t, _ in theirs] == ["".join(codec.symbols[b] for b in w.encode()) for w in words], hex(ord(c))


def test_prefixes_are_computed_once(codec):
    """Words that share a stem of 300 letters cost its nodes once: counted by the looks for the letters' lengths."""

    class Counted(dict):
        looks = 0

        def __getitem__(self, key):
            Counted.looks += 1
            return dict.__getitem__(self, key)

    own = bpe.Vocabulary(PATH)
    own.lengths = Counted(own.lengths)
    stem = "abcde" * 60
    own.walk({stem + x + chr(ord("z") + bpe.END) for x in "abcdefghij"})
    assert Counted.looks == 300 + 2 * 10


def test_forgetting_changes_nothing(codec):
    small = bpe.Codec(PATH, known_chars=500)
    rng = random.Random(6)
    texts = ["".join(rng.choices("abcdefgh '1é", k=200)) for _ in range(60)]
    assert [small.encode([t])[0] for t in texts] == codec.encode(texts)


def test_long_words_are_linear(codec):
    assert same(codec, "ab" * 20000 + " " + "a" * 20001 + "-" * 5000)


def test_query_and_round_trip(spark, codec, docs_of, tmp_path):
    texts = ["Hello hello, WORLD 42!", "", None, "café <|endoftext|> x", "Hello hello, WORLD 42!", "  \n ", "word " * 5000]
    docs = docs_of([(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (1, "second row of 1")])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = bpe.op11_prefix_trie(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts) + 2
    expected = []
    for i, t in [*enumerate(texts), (None, "null id"), (1, "second row of 1")]:
        e = codec.library.encode(t or "", add_special_tokens=False).ids
        plain = codec.library.decode(e, skip_special_tokens=False)
        expected.append((i, len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256(plain.encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=str) == sorted(expected, key=str)
    coded = bpe.decode(bpe.encode(docs))
    assert set(docs.columns) < set(coded.columns)
    for r in coded.collect():
        theirs = codec.library.encode(r.text or "", add_special_tokens=False)
        assert r.ids == theirs.ids and r.decoded == " ".join(theirs.tokens)
    odd = spark.createDataFrame([(None,), ([],), ([0, None, 10**6, 49407],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(odd).collect()] == [None, "", "! <|endoftext|>"]
    assert bpe.digests(docs.where(F.lit(False))).count() == 0
