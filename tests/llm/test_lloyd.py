import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from findery.llm import lloyd

SCHEMA = "vec_id long, embedding array<float>, label int, comps string, old int, part string, s0 date"


def plain(rows, n_parts=4, n_entries=256, rounds=4):
    """The rounds over all rows in Python, without deltas."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    ints = [[math.floor(1024 * float(np.float32(x))) for x in r[1]] for r in kept]
    width = len(ints[0]) // n_parts
    cut = lambda v, p: tuple(v[p * width : (p + 1) * width])
    firsts = [v for _, v in sorted((r[0], v) for r, v in zip(kept, ints, strict=True) if r[0] is not None)][:n_entries]
    books = [[cut(v, p) for v in firsts] for p in range(n_parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    place = lambda v: [min((far(cut(v, p), e), i) for i, e in enumerate(books[p])) for p in range(n_parts)]
    for _ in range(rounds):
        codes = [place(v) for v in ints]
        for p in range(n_parts):
            for i in range(len(books[p])):
                of = [cut(v, p) for v, c in zip(ints, codes, strict=True) if c[p][1] == i]
                if of:
                    books[p][i] = tuple(sum(x) // len(of) for x in zip(*of, strict=True))
    sha = hashlib.sha256(",".join(str(x) for part in books for e in part for x in e).encode()).hexdigest()
    out, by_label = [], {}
    for r, v in zip(kept, ints, strict=True):
        found = place(v)
        out.append((r[0], "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found), r[2]))
        by_label[r[2]] = by_label.get(r[2], 0) + out[-1][2]
    return sorted(((a, b, c, by_label[d], sha) for a, b, c, d in out), key=str)


def table(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "mine", 1, "p", None) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    return sorted(map(tuple, lloyd.op12_delta_lloyd(spark, str(tmp_path)).collect()), key=str)


def vectors(n, width=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, width))
    return [(i * 3, [float(x) for x in (centres[i % 7] + rng.normal(size=width) * 0.3).astype(np.float32)], None if i % 5 == 0 else i % 4) for i in range(n)]


@pytest.mark.parametrize("n", [1, 40, 600])
def test_query_equals_plain_rounds(spark, tmp_path, n):
    rows = vectors(n)
    rows += [(5, None, 1), (None, rows[0][1], 2), (6, [1.0, None] * 8, 1), (7, [float("nan")] * 16, 1), (8, [float("inf")] * 16, 1), rows[0], rows[n // 2]]
    assert table(spark, tmp_path, rows) == plain(rows)


def test_ties_go_to_the_lower_index(spark, tmp_path):
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate([[0, 0, 0, 0], [0, 0, 0, 0], [2, 2, 2, 2], [1, 1, 1, 1], [-1, -1, -1, -1]])]
    found = table(spark, tmp_path, rows)
    assert found == plain(rows) and found[1][1] == "00000000"


def test_odd_tables(spark, tmp_path):
    (tmp_path / "a").mkdir()
    assert table(spark, tmp_path / "a", []) == []
    assert [r[:4] for r in table(spark, tmp_path / "b", [(None, [1.0] * 4, 1)])] == [(None, None, None, None)]
    mixed = [(1, [1.0] * 8, 1), (2, [2.0] * 8, 1), (3, [1.0] * 4, 1), (4, [], None), (5, [1.0] * 7, 2), (6, [3e38] * 8, 3)]
    found = {r[0]: r for r in table(spark, tmp_path / "c", mixed)}
    assert found[1][1] == "00000000" and found[3][1:3] == found[4][1:4][:2] == (None, None) and found[5][3] is None and found[3][3] == 0 and found[6][1] is not None


def test_only_changed_parts_are_shuffled(spark):
    rows = spark.createDataFrame([([1, 2, 3, 4], [0, 1], [0, 1]), ([5, 6, 7, 8], [0, 2], [0, 1]), ([1, 1, 1, 1], [3, 0], None)], "comps array<int>, codes array<int>, old array<int>")
    got = {(r.part, r.entry): (r.n, r.s0, r.s1) for r in lloyd.contributions(rows, 2, 2).collect()}
    assert got == {(1, 1): (-1, -7, -8), (1, 2): (1, 7, 8), (0, 3): (1, 1, 1), (1, 0): (1, 1, 1)}


def test_large_components_are_exact():
    parts = np.array([[1 << 24, -(1 << 24)] * 8], np.int64)
    book = np.array([[-(1 << 24), 1 << 24] * 8, [(1 << 24) - 1, -(1 << 24)] * 8], np.int64)
    assert [x.tolist() for x in lloyd.nearest(parts, book)] == [[1], [8]]


def test_decode_comes_near(spark):
    rows = vectors(300)
    found = lloyd.fit(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert found.rows.columns == ["vec_id", "label", "comps", "codes", "error"]
    for r in lloyd.decode(found).where(F.col("codes").isNotNull()).collect():
        assert sum((round(x * 1024) - c) ** 2 for x, c in zip(r.approx, r.comps, strict=True)) == r.error
