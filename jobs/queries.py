"""The jobs as queries: each runs twice on the whole tables into a new shared folder, whose output is read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from findery.operators import chunk, judge
from findery.plans import catalogue as c
from findery.session import temporary

from . import passages, retrieval_report


def job1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' passages; the second run finds nothing new."""
    folder = temporary(spark, "job1")
    for _ in range(2):
        passages.run(spark, f"{sf_dir}/documents.parque[t]", f"{folder}/table", f"{folder}/checkpoint")
    return passages.read(spark, f"{folder}/table")


def job2_retrieval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two retrievers on all items and documents; the second run replaces the partitions by the same ones."""
    folder = temporary(spark, "job2")
    for _ in range(2):
        retrieval_report.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", folder)
    return retrieval_report.read(spark, folder)


_WORDS = rf"string_split({c.SQUEEZE % 'line'}, ' ')"
#: Units are lines, longer ones in parts. From each unit the end of a passage that begins there is known (also if it
#: begins with a carried unit, which takes the next one with it in any case), so passages are found from end to end.
_PASSAGES = rf"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, coalesce(source, '') AS source, {c.LINES % (c.HYPHENS, c.HYPHENS)} AS l, []::VARCHAR[] AS k FROM documents WHERE text IS NOT NULL),
t AS MATERIALIZED (SELECT r, source, {c._CLEANED} AS text FROM d),
w AS (SELECT r, i, {_WORDS} AS w FROM (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM t) WHERE {c.SQUEEZE % 'line'} <> ''),
p AS (SELECT r, i, j, w[j * {chunk.MAX_TOKENS} + 1 : (j + 1) * {chunk.MAX_TOKENS}] AS w FROM (SELECT *, unnest(range((len(w) - 1) // {chunk.MAX_TOKENS} + 1)) AS j FROM w)),
u AS MATERIALIZED (SELECT r, row_number() OVER (PARTITION BY r ORDER BY i, j) AS i, array_to_string(w, ' ') AS text, len(w) AS n, sum(len(w)) OVER (PARTITION BY r ORDER BY i, j) AS upto, count(*) OVER (PARTITION BY r) AS units FROM p),
f AS MATERIALIZED (SELECT a.r, a.i, any_value(a.units) AS units, max(b.i) AS e FROM u a JOIN u b ON a.r = b.r AND b.i >= a.i AND b.upto - a.upto + a.n <= {chunk.MAX_TOKENS} GROUP BY a.r, a.i),
e AS MATERIALIZED (SELECT f.r, f.i, c, f.units, greatest(f.i + c, f.e) AS e, u.n AS last FROM f CROSS JOIN (VALUES (0), (1)) v(c) JOIN u ON u.r = f.r AND u.i = greatest(f.i + c, f.e)),
walk AS (SELECT r, 0 AS part, i, c, e, units, last FROM e WHERE i = 1 AND c = 0
  UNION ALL SELECT w.r, w.part + 1, e.i, e.c, e.e, e.units, e.last FROM walk w JOIN e ON e.r = w.r AND w.e < w.units AND e.i = CASE WHEN w.last <= {chunk.OVERLAP_TOKENS} THEN w.e ELSE w.e + 1 END AND e.c = CASE WHEN w.last <= {chunk.OVERLAP_TOKENS} THEN 1 ELSE 0 END),
b AS (SELECT walk.r, part, string_agg(u.text, chr(10) || chr(10) ORDER BY u.i) AS text, sum(n)::INT AS n_tokens FROM walk JOIN u ON u.r = walk.r AND u.i BETWEEN walk.i AND walk.e GROUP BY walk.r, part)
SELECT DISTINCT substr(sha1(source || '||' || part || '|' || b.text), 1, 16) AS id, b.text, part::INT AS part, n_tokens, source FROM b JOIN t USING (r) WHERE n_tokens >= {chunk.MIN_TOKENS}"""


def _report(name: str, base: str, table: str) -> str:
    a, b = c.COMPARABLE % "b.text", c.COMPARABLE % "d.text"
    return f"""(WITH {base}, hits AS (SELECT query_id, rank, id, score FROM {table} WHERE rank <= 20),
j AS (SELECT query_id, min(rank) FILTER (length({a}) >= {judge.MIN_EVIDENCE} AND (contains({b}, {a}) OR ({b} <> '' AND contains({a}, {b})))) AS f FROM hits JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = id GROUP BY query_id),
v AS (SELECT query_id, unnest(['recall@1', 'recall@5', 'mrr@10']) AS metric, unnest([(coalesce(f, 99) <= 1)::INT::DOUBLE, (coalesce(f, 99) <= 5)::INT::DOUBLE, CASE WHEN f <= 10 THEN 1 / f::DOUBLE ELSE 0 END]) AS value FROM (SELECT item_id AS query_id, f FROM benchmark LEFT JOIN j ON query_id = item_id)),
{c._boot("v", "query_id::VARCHAR")}, limits AS ({c._CI})
SELECT '{name}' AS retriever, 'hit' AS kind, query_id, NULL AS metric, rank::INT AS rank, id, score AS value FROM hits
UNION ALL SELECT '{name}', 'question', query_id, metric, NULL, NULL, value FROM v
UNION ALL SELECT '{name}', kind, NULL, metric, NULL, NULL, value FROM (SELECT metric, unnest(['n', 'mean', 'lo', 'hi']) AS kind, unnest([n::DOUBLE, mean, lo, hi]) AS value FROM limits))"""


QUERIES = {"job1_passages": job1_passages, "job2_retrieval_report": job2_retrieval_report}
SQL = {
    "job1_passages": _PASSAGES,
    "job2_retrieval_report": f"SELECT * FROM {_report('bm25', c._BM25 % 'true', 'h')} UNION ALL SELECT * FROM {_report('overlap', c._OVERLAP % 'true', 'r')}",
}
