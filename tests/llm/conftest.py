"""Fixtures of the training-data operators; the session comes from the folder above."""

import datetime
import random

import pytest


@pytest.fixture(scope="session")
def words():
    rng = random.Random(7)
    parts = ["an", "the", "er", "ou", "st", "ing", "ble", "re", "tion", "nd", "ha", "es"]
    return lambda n, seed=None: " ".join("".join((random.Random(f"{seed}-{i}") if seed is not None else rng).choices(parts, k=3)) for i in range(n))


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows (doc_id, text, lang, source) as documents with columns that clash with names inside the operators."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, keys array<string>, tokens date, size double, target string, `group` string"

    def make(rows):
        extra = ["k"], datetime.date(2020, 1, 1), 1.5, "t", "g"
        full = [(*r, *([None] * (4 - len(r))), None if r[1] is None else len(r[1]), "mine", *extra) for r in rows]
        return spark.createDataFrame(full, schema)

    return make
