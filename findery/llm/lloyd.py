"""Codes of vectors by product quantisation, with Lloyd's rounds that are maintained by deltas (operator 12).

Components are integers, so that all sums are exact and every order of additions gives the same codebooks. Each round is
one pass that assigns parts to their nearest entries and writes the assignments beside the earlier ones. Only parts
whose assignment has changed then take part in a shuffle: minus at the old entry, plus at the new one, summed before it.
The running sums and counts (a row an entry) are written each round too; codebooks follow from them."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
REACH = 1 << 24  # components are kept within it, so that squared distances are longs
EXACT = 1 << 53  # up to which doubles hold every integer
CELLS = 1 << 22  # of a table of distances at a time


@dataclass
class Codes:
    """rows: the given rows with comps, codes and error; books: entries by part, as integers (parts x entries x width)."""

    rows: DataFrame
    books: np.ndarray

    def digest(self) -> str:
        """Of all components in decimal, by part, entry and position, with commas between."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def whole_components(vector, scale: int = SCALE):
    """floor(scale * x) of each component, kept within REACH; null for a vector that is null or holds null or non-finite
    components."""
    fine = F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))), F.lit(False))
    low = lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(REACH))), F.lit(float(-REACH)))).cast("int")
    return F.when(fine, F.transform(vector, low))


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row of parts, ties to the lower index, and its squared distance; exact."""
    best, errors = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
    greatest = max(int(np.abs(parts).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * greatest**2 * max(1, parts.shape[1]) < EXACT else np.int64
    entries = book.astype(kind)
    squares = (entries * entries).sum(1)
    step = max(1, CELLS // max(1, len(book)))
    for at in range(0, len(parts), step):
        some = parts[at : at + step].astype(kind)
        far = squares - 2 * (some @ entries.T)
        found = far.argmin(1)
        best[at : at + step] = found
        errors[at : at + step] = (far[np.arange(len(some)), found] + (some * some).sum(1)).astype(np.int64)
    return best, errors


def assign(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """rows (comps, codes, ...) with codes as old, the nearest entries of books as codes, and the error."""
    n_parts, _, width = books.shape
    common.small_batches(rows.sparkSession)
    kept = [f for f in rows.schema.fields if f.name not in ("codes", "old", "error")]
    schema = T.StructType([*kept, *T._parse_datatype_string("codes array<int>, old array<int>, error long").fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("comps"))
            parts = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), n_parts, width)
            found = [nearest(parts[:, p], books[p]) for p in range(n_parts)]
            codes = np.stack([f[0] for f in found], 1).astype(np.int32)
            starts = pa.array(np.arange(0, codes.size + 1, n_parts, dtype=np.int32))
            made = [
                *(batch.column(batch.schema.get_field_index(f.name)) for f in kept),
                pa.ListArray.from_arrays(starts, pa.array(codes.ravel())),
                batch.column(batch.schema.get_field_index("codes")),
                pa.array(np.sum([f[1] for f in found], 0)),
            ]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(made, arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(run, schema)


def contributions(rows: DataFrame, n_parts: int, width: int) -> DataFrame:
    """part, entry, n and the sums s0, s1, ... of what parts with a changed assignment take away and add."""
    moves = []
    for p in range(n_parts):
        was, now = F.get("old", F.lit(p)), F.get("codes", F.lit(p))
        moved = ~was.eqNullSafe(now)
        comps = F.slice("comps", p * width + 1, width)
        for entry, sign in ((was, -1), (now, 1)):
            moves.append(F.when(moved & entry.isNotNull(), F.struct(F.lit(p).alias("part"), entry.alias("entry"), F.lit(sign).cast("long").alias("sign"), comps.alias("comps"))))
    moved = rows.select(F.explode(F.array_compact(F.array(*moves))).alias("m")).select("m.*")
    sums = (F.sum(F.col("sign") * F.get("comps", F.lit(i))).cast("long").alias(f"s{i}") for i in range(width))
    return moved.groupBy("part", "entry").agg(F.sum("sign").cast("long").alias("n"), *sums)


def common_width(rows: DataFrame, n_parts: int) -> int:
    """The number of components that most vectors have, of those that can be cut into the parts; 0 if there is none."""
    sizes = rows.groupBy(F.size("comps").alias("size")).count().where((F.col("size") > 0) & (F.col("size") % n_parts == 0))
    first = sizes.orderBy(F.desc("count"), "size").first()
    return first["size"] if first else 0


def fit(vectors: DataFrame, n_parts: int = PARTS, n_entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codes:
    """Codes of vectors (vec_id, embedding, any others).

    Rows whose vector is null or holds null or non-finite components go. Codebooks start as the parts of the rows with
    the least ids (nulls don't count; of the same id the least vector first). Vectors of another length than most, or of
    one that can't be cut into equal parts, and all if no row has an id, stay with null codes and error."""
    rows, _ = common.shield(vectors, ("vec_id", "embedding"))
    rows = rows.withColumn("comps", whole_components(F.col("embedding"), scale)).where("comps is not null").drop("embedding")
    rows = common.stage(rows, "vectors")
    size = common_width(rows, n_parts)
    fitting = rows.where(F.size("comps") == size)
    first = fitting.where("vec_id is not null").orderBy("vec_id", "comps").limit(n_entries).select("comps").collect() if size else []
    none = rows.select("*", F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("long").alias("error"))
    if not first:
        return Codes(_named(none, vectors), np.zeros((n_parts, 0, 0), np.int64))
    width = size // n_parts
    books = np.array([r.comps for r in first], np.int64).reshape(len(first), n_parts, width).transpose(1, 0, 2).copy()
    state = fitting.withColumn("codes", F.lit(None).cast("array<int>"))
    totals: DataFrame | None = None
    for k in range(rounds):
        state = common.stage(assign(state, books), f"assigned-{k}")
        deltas = contributions(state, n_parts, width)
        if totals is not None:
            sums = (F.sum(c).cast("long").alias(c) for c in deltas.columns[2:])
            deltas = totals.unionByName(deltas).groupBy("part", "entry").agg(*sums)
        totals = common.stage(deltas, f"sums-{k}")
        for r in totals.where("n > 0").collect():  # a row an entry at most
            books[r.part, r.entry] = [r[f"s{i}"] // r.n for i in range(width)]
    last = common.stage(assign(state, books).drop("old"), "coded")
    return Codes(_named(last.unionByName(none.where(F.size("comps") != size)), vectors), books)


def _named(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """rows with the columns of vectors under their names again; comps, codes and error come after them, and take the
    place of columns so called."""
    made = ("comps", "codes", "error")
    own = [(c if c == "vec_id" else f"carried_{i}_", c) for i, c in enumerate(vectors.columns) if c != "embedding" and c.lower() not in made]
    return rows.select(*(F.col(n).alias(c) for n, c in own), *made)


def decode(codes: Codes, scale: int = SCALE) -> DataFrame:
    """rows with approx, the vector that the codes stand for."""
    books = F.array(*(F.array(*(F.array(*(F.lit(float(x)) for x in entry)) for entry in part)) for part in codes.books.tolist()))
    entry = lambda p: F.get(F.get(books, F.lit(p)), F.get("codes", F.lit(p)))
    joined = F.concat(*(entry(p) for p in range(len(codes.books))))
    return codes.rows.withColumn("approx", F.transform(joined, lambda x: x / scale))


def op12_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each kept vector: vec_id, code, error, label_error, codebooks_sha256. Rows without a code (see fit) have
    a null code and error, and add nothing to label_error, which is null if no row of the label has an error."""
    vectors = common.load(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    found = fit(vectors)
    by_label = found.rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    hexed = F.when(F.col("codes").isNotNull(), F.lower(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0")), "")))
    rows = found.rows.select("vec_id", "label", hexed.alias("code"), "error")
    return common.join_params(rows, by_label, "label").select("vec_id", "code", "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))


def _sql() -> str:
    """The same rounds over all rows, without deltas: means of whole parts."""
    best = """SELECT r, p, arg_min(e, d * 256 + e) AS e, min(d) AS d, any_value(c) AS c FROM (
    SELECT r, p, e, c, CAST(list_sum(list_transform(list_zip(c, b), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM parts JOIN book{k} USING (p)) GROUP BY r, p"""
    means = """SELECT p, e, coalesce(m, b) AS b FROM book{k} LEFT JOIN (
    SELECT p, e, list(m ORDER BY i) AS m FROM (
        SELECT p, e, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS m FROM (
            SELECT p, e, unnest(range(len(c))) AS i, unnest(c) AS x FROM near{k}) GROUP BY p, e, i) GROUP BY p, e) USING (p, e)"""
    steps = []
    for k in range(ROUNDS):
        steps += [f"near{k} AS MATERIALIZED ({best.format(k=k)})", f"book{k + 1} AS MATERIALIZED ({means.format(k=k)})"]
    return f"""WITH kept AS MATERIALIZED (
    SELECT vec_id, label, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
parts AS MATERIALIZED (SELECT r, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS c FROM kept, range({PARTS}) t(p)),
book0 AS MATERIALIZED (SELECT p, e, c AS b FROM parts JOIN (SELECT r, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM kept WHERE vec_id IS NOT NULL) USING (r) WHERE e < {ENTRIES}),
{", ".join(steps)},
last AS MATERIALIZED ({best.format(k=ROUNDS)}),
coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY r),
told AS (SELECT sha256(string_agg(array_to_string(b, ','), ',' ORDER BY p, e)) AS sha FROM book{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256
FROM kept JOIN coded USING (r), told"""


SQL = _sql()
