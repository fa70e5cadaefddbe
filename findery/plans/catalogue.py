"""Queries that apply the operators to the tables of a folder, with the SQL of those that have one.

documents stand for pages and chunks (doc_id, source), benchmark for questions with their evidence, embeddings for
stored vectors, pages for documents with headings, conversations for answers and replies."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompt, vectors
from ..functions import text as tx
from ..operators import answer, calibrate, cells, chunk, clean, index, judge, metrics, questions, retrieve, sections
from ..session import bounded, freeing, settled, spread, temporary
from ..sources import records
from ..sources.inverted import InvertedIndex
from ..sources.store import VectorStore
from . import evaluate, ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

W = r"[\p{L}\p{N}_]"
S = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
TOKENS = rf"regexp_extract_all(lower(text), '{W}+')"
STRIP = rf"regexp_replace(%s, '^{S}+|{S}+$', '', 'g')"
SQUEEZE = STRIP % rf"regexp_replace(%s, '{S}+', ' ', 'g')"
COMPARABLE = "lower(" + SQUEEZE % f"translate(%s, '{tx.DASHES}{tx.CURLY.replace(chr(39), chr(39) * 2)}{tx.MARKUP}', '-------''''\"\"')" + ")"
N_WORDS = f"CASE WHEN {SQUEEZE % 'text'} = '' THEN 0 ELSE len(string_split({SQUEEZE % 'text'}, ' ')) END"
KEY = r"lower(regexp_replace(regexp_replace(%s, '\p{Nd}+', '', 'g'), '^[ *_#|\-•\t]+|[ *_#|\-•\t]+$', '', 'g'))"
LINES = r"list_filter(string_split(%s, chr(10)), lambda x, i: i < len(string_split(%s, chr(10))) OR x <> '')"
HYPHENS = rf"regexp_replace(text, '({W})-\n({W})', '\1\2', 'g')"
REPEATS = 200
DEPTH = 20


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def as_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "text", F.struct("source", F.col("lang").alias("section"), F.lit(1).alias("page"), F.lit(0).alias("part")).alias("metadata"))


def as_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item asks for itself; it is labelled with a source and language by its number."""
    k = F.col("item_id")
    label = F.array(F.struct(F.concat(F.lit("src"), (k % 20).cast("string")).alias("source"), F.element_at(F.array(F.lit("en"), F.lit("de")), (k % 2 + 1).cast("int")).alias("section"), F.lit(1).alias("page")))
    kind = F.element_at(F.array(*map(F.lit, ("factual", "conceptual", "keyword"))), (k % 3 + 1).cast("int"))
    return load(spark, sf_dir, "benchmark").select(k.alias("query_id"), F.col("text").alias("query"), kind.alias("type"), F.col("text").alias("evidence"), label.alias("relevant"), F.concat(F.lit("g"), (k % 7).cast("string")).alias("group"))


# ---------------------------------------------------------------- text and ingest


@query("tokenize_terms", f"SELECT doc_id, len({TOKENS})::INT AS n_words, len(list_distinct({TOKENS}))::INT AS n_terms FROM documents")
def tokenize_terms(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.size(tx.tokens(F.col("text"))).alias("n_words"), F.size(tx.token_set(F.col("text"))).alias("n_terms"))


@query(
    "postings_stats",
    f"""WITH p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents)
    SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, round(ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM p, n GROUP BY term""",
)
def postings_stats(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    n = docs.agg(F.count("*").alias("n"))
    counts = index.postings(docs, "doc_id").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    return counts.crossJoin(F.broadcast(n)).select("term", "df", "cf", F.round(index.idf(F.col("df"), F.col("n")), 6).alias("idf"))


_CLEANED = rf"""{STRIP % rf"regexp_replace(regexp_replace(array_to_string(list_transform(list_filter(l, lambda x: {STRIP % 'x'} = '' OR NOT (list_contains(k, {KEY % (STRIP % 'x')}) OR regexp_matches({STRIP % 'x'}, '^\p{{Nd}}{{1,4}}$'))), lambda x: regexp_replace(x, '{S}+$', '')), chr(10)), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"}"""
_EDGES = rf"""e AS (SELECT source, doc_id, list_filter(list_transform({LINES % ('text', 'text')}, lambda x: {STRIP % 'x'}), lambda x: x <> '') AS f FROM documents),
 k AS (SELECT DISTINCT source, doc_id, unnest(list_transform(list_concat(f[1:2], f[greatest(len(f) - 1, 1):]), lambda x: {KEY % 'x'})) AS key FROM e),
 c AS (SELECT source, key, count(*) AS n FROM k WHERE key <> '' GROUP BY ALL), p AS (SELECT source, count(*) AS n_pages FROM documents GROUP BY ALL),
 b AS (SELECT source, list_sort(list(key)) AS k FROM c JOIN p USING (source) WHERE n_pages >= 5 AND n >= greatest(5, 0.03 * n_pages) GROUP BY source)"""


@query("clean_text", rf"WITH d AS (SELECT doc_id, {LINES % (HYPHENS, HYPHENS)} AS l, []::VARCHAR[] AS k FROM documents) SELECT doc_id, md5({_CLEANED}) AS cleaned FROM d")
def clean_text(spark, sf_dir):
    none = F.array().cast("array<string>")
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(clean.cleaned(F.col("text"), none)).alias("cleaned"))


@query("edge_line_boilerplate", f"WITH {_EDGES} SELECT source, array_to_string(k, chr(10)) AS keys FROM b")
def edge_line_boilerplate(spark, sf_dir):
    return clean.boilerplate(load(spark, sf_dir, "documents"), "source").select("source", F.array_join("keys", "\n").alias("keys"))


@query(
    "clean_pages",
    rf"WITH {_EDGES}, d AS (SELECT doc_id, {LINES % (HYPHENS, HYPHENS)} AS l, coalesce(b.k, []) AS k FROM documents LEFT JOIN b USING (source)), r AS (SELECT doc_id, {_CLEANED} AS t FROM d) SELECT doc_id, md5(t) AS cleaned FROM r WHERE t <> ''",
)
def clean_pages(spark, sf_dir):
    pages = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return clean.clean_pages(pages, "source").select("doc_id", F.md5("text").alias("cleaned"))


def as_book_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a host as one document: headings become Markdown ones, a third of them numbered; tags are dropped."""
    k = F.col("page_id")
    number = F.when(k % 3 == 0, F.concat((k % 9 + 1).cast("string"), F.when(k % 2 == 0, F.concat(F.lit("."), (k % 5 + 1).cast("string"))).otherwise(""), F.lit(" "))).otherwise("")
    mark = F.concat(F.lit("\n"), F.repeat(F.lit("#"), (k % 3 + 1).cast("int")), F.lit(" "), number)
    text = F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>", ""), "</?(p|br|div|h[1-6]|li)[^>]*>", "\n")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    body = F.regexp_replace(text, "<[^>]*>", "")
    return load(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("doc"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("source"), k.cast("int").alias("page"), F.concat(mark, title, F.lit("\n"), body).alias("text"))


_BOOK = r"""book AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS doc, page_id AS page, chr(10) || repeat('#', (page_id % 3 + 1)::INT) || ' ' ||
  CASE WHEN page_id % 3 = 0 THEN (page_id % 9 + 1) || CASE WHEN page_id % 2 = 0 THEN '.' || (page_id % 5 + 1) ELSE '' END || ' ' ELSE '' END ||
  regexp_extract(html, '<title>([^<]*)</title>', 1) || chr(10) || regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '</?(p|br|div|h[1-6]|li)[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS text FROM pages),
lines AS (SELECT doc, page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM book),
heads AS (SELECT *, len(regexp_extract(line, '^(#{1,6})[\s\x0b\x1c-\x1f\x85\p{Z}]+(.+)$', 1)) AS hashes, regexp_extract(line, '^(#{1,6})[\s\x0b\x1c-\x1f\x85\p{Z}]+(.+)$', 2) AS raw FROM lines),
titled AS (SELECT *, """ + (SQUEEZE % "regexp_replace(regexp_replace(regexp_replace(raw, '<[^>]+>', '', 'g'), '\\*+', '', 'g'), '(^|[^\\p{L}\\p{N}_])_+|_+($|[^\\p{L}\\p{N}_])', '\\1\\2', 'g')") + r""" AS title FROM heads WHERE hashes > 0),
deep AS (SELECT *, regexp_extract(title, '^(\d{1,2}(?:\.\d{1,2})*|[A-Z](?:\.\d{1,2})+)\.?\s+[A-Z"''(“]', 1) AS number FROM titled),
headings AS (SELECT doc, page, line_no, hashes, title, CASE WHEN number <> '' THEN len(number) - len(replace(number, '.', '')) + 1 END AS depth FROM deep)"""


@query("heading_levels", f"WITH {_BOOK} SELECT doc, page::INT AS page, line_no::INT AS line_no, hashes::INT AS hashes, title, depth::INT AS depth FROM headings WHERE title <> '' AND NOT regexp_matches(title, '(?i)^(figure|table)\\s+\\d')")
def heading_levels(spark, sf_dir):
    return sections.heading_lines(as_book_pages(spark, sf_dir)).where("is_heading").select("doc", "page", "line_no", "hashes", "title", "depth")


@query(
    "numbering_profile",
    f"""WITH {_BOOK}, c AS (SELECT doc, depth, hashes, count(*) AS n, min((page, line_no)) AS first FROM headings WHERE depth IS NOT NULL GROUP BY ALL),
    u AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY depth, n DESC, first) AS k, max(depth) OVER (PARTITION BY doc) AS deepest FROM c)
    SELECT doc, (hashes - depth)::INT AS shift, deepest::INT AS max_depth FROM u WHERE k = 1""",
)
def numbering_profile(spark, sf_dir):
    return sections.numbering_profile(sections.heading_lines(as_book_pages(spark, sf_dir)))


_TITLED = r"title <> '' AND NOT regexp_matches(title, '(?i)^(figure|table)\s+\d')"


@query(
    "section_paths",
    f"""WITH RECURSIVE {_BOOK}, hd AS (SELECT doc, page, line_no, hashes, depth, title, row_number() OVER (PARTITION BY doc ORDER BY page, line_no) AS k FROM headings WHERE {_TITLED}),
    c AS (SELECT doc, depth, hashes, count(*) AS n, min((page, line_no)) AS first FROM headings WHERE depth IS NOT NULL GROUP BY ALL),
    u AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY depth, n DESC, first) AS j, max(depth) OVER (PARTITION BY doc) AS deepest FROM c),
    h AS (SELECT hd.*, greatest(1, hashes - coalesce(u.hashes_of - u.depth_of, 0)) AS signs, coalesce(deepest, 0) AS deepest FROM hd LEFT JOIN (SELECT doc, hashes AS hashes_of, depth AS depth_of, deepest FROM u WHERE j = 1) u USING (doc)),
    open_at AS (SELECT DISTINCT doc, 0::BIGINT AS k, []::STRUCT(level BIGINT, title VARCHAR, numbered BOOLEAN)[] AS stack FROM h
      UNION ALL SELECT doc, k, list_append(list_filter(stack, lambda o: o.level < lv), {{'level': lv, 'title': title, 'numbered': depth IS NOT NULL}}) FROM
      (SELECT h.doc, h.k, h.title, h.depth, stack, CASE WHEN depth IS NOT NULL THEN depth WHEN signs >= deepest THEN greatest(signs, 1 + coalesce(list_max(list_transform(list_filter(stack, lambda o: o.numbered), lambda o: o.level)), 0)) ELSE signs END::BIGINT AS lv
       FROM open_at JOIN h ON h.doc = open_at.doc AND h.k = open_at.k + 1)),
    placed AS (SELECT l.*, hd.k IS NOT NULL AS heading, count(hd.k) OVER (PARTITION BY l.doc ORDER BY l.page, l.line_no) AS section_no FROM lines l LEFT JOIN hd ON hd.doc = l.doc AND hd.page = l.page AND hd.line_no = l.line_no),
    body AS (SELECT doc, section_no, string_agg(line, chr(10) ORDER BY page, line_no) AS text, min(page) FILTER ({STRIP % 'line'} <> '') AS page FROM placed WHERE NOT heading GROUP BY ALL)
    SELECT body.doc, section_no::INT AS section_no, coalesce(array_to_string(list_transform(stack, lambda o: o.title), ' > '), '') AS path, page::INT AS page, md5({STRIP % 'text'}) AS text
    FROM body LEFT JOIN open_at o ON o.doc = body.doc AND o.k = section_no WHERE page IS NOT NULL""",
)
def section_paths(spark, sf_dir):
    rows = sections.split_sections(as_book_pages(spark, sf_dir))
    return rows.select("doc", "section_no", F.array_join("path", " > ").alias("path"), "page", F.md5("text").alias("text"))


@query("paragraph_pack")
def paragraph_pack(spark, sf_dir):
    """Lines of documents as paragraphs, packed into chunks."""
    docs = load(spark, sf_dir, "documents").select("source", F.lit(1).alias("page"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"), F.array("lang").alias("path"))
    return chunk.chunk_sections(docs).select("id", "metadata.source", "metadata.section", "metadata.part", "n_tokens")


@query("chunk_ids", "SELECT doc_id, substr(sha1(source || '|' || lang || '|0|' || text), 1, 16) AS id FROM documents")
def chunk_ids(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", tx.sha1_prefix(F.col("source"), F.col("lang"), F.lit("0"), F.col("text")).alias("id"))


@query("chunk_size_stats", f"WITH n AS (SELECT {N_WORDS} AS n_tokens FROM documents) SELECT count(*) AS n, min(n_tokens)::INT AS least, list_sort(list(n_tokens))[count(*) // 2 + 1]::INT AS middle, max(n_tokens)::INT AS most FROM n")
def chunk_size_stats(spark, sf_dir):
    return chunk.size_stats(load(spark, sf_dir, "documents").select(tx.count_words(F.col("text")).alias("n_tokens")))


@query("ingest_documents")
def ingest_documents(spark, sf_dir):
    """Whole ingest of the book pages: clean, split, chunk."""
    return ingest.ingest_pages(as_book_pages(spark, sf_dir)).select("id", "metadata.source", "metadata.section", "metadata.page", "metadata.part", "n_tokens")


@query("norm_text", f"SELECT doc_id, md5({COMPARABLE % 'text'}) AS norm FROM documents")
def norm_text(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(tx.comparable(F.col("text"))).alias("norm"))


# ---------------------------------------------------------------- retrieval

_ASKED = f"q AS (SELECT item_id AS query_id, len(t) AS m, unnest(t) AS term, 'src' || mod(item_id, 20) AS want FROM (SELECT item_id, list_distinct({TOKENS}) AS t FROM benchmark))"
_OVERLAP = f"""{_ASKED}, d AS (SELECT doc_id, source, unnest(list_distinct({TOKENS})) AS term FROM documents),
s AS (SELECT query_id, doc_id AS id, count(*) / any_value(m)::DOUBLE AS score FROM q JOIN d USING (term) WHERE %s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)"""
_BM25 = f"""{_ASKED}, w AS (SELECT doc_id, source, {TOKENS} AS t FROM documents), whole AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM w),
p AS (SELECT doc_id, any_value(source) AS source, any_value(n_words) AS n_words, term, count(*) AS tf FROM (SELECT doc_id, source, len(t) AS n_words, unnest(t) AS term FROM w) GROUP BY doc_id, term),
f AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf, any_value(mean) AS mean FROM p, whole GROUP BY term, n),
s AS (SELECT query_id, doc_id AS id, round(sum(idf * tf * {retrieve.K1 + 1} / (tf + {retrieve.K1} * (1 - {retrieve.B} + {retrieve.B} * n_words / mean))), 6) AS score FROM q JOIN p USING (term) JOIN f USING (term) WHERE %s GROUP BY ALL),
h AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)"""


def scoped_questions(spark, sf_dir):
    return as_questions(spark, sf_dir).withColumn("source", F.get("relevant", F.lit(0))["source"])


@query("overlap_topk", f"WITH {_OVERLAP % 'true'} SELECT query_id, rank::INT AS rank, id, score FROM r WHERE rank <= 5")
def overlap_topk(spark, sf_dir):
    return retrieve.overlap(as_questions(spark, sf_dir), as_chunks(spark, sf_dir))


@query("overlap_topk_source", f"WITH {_OVERLAP % 'want = source'} SELECT query_id, rank::INT AS rank, id, score FROM r WHERE rank <= 5")
def overlap_topk_source(spark, sf_dir):
    return retrieve.overlap(scoped_questions(spark, sf_dir), as_chunks(spark, sf_dir))


@query("bm25_topk", f"WITH {_BM25 % 'true'} SELECT query_id, rank::INT AS rank, id, score FROM h WHERE rank <= 5")
def bm25_topk(spark, sf_dir):
    return retrieve.bm25(as_questions(spark, sf_dir), as_chunks(spark, sf_dir))


@query("bm25_topk_source", f"WITH {_BM25 % 'want = source'} SELECT query_id, rank::INT AS rank, id, score FROM h WHERE rank <= 5")
def bm25_topk_source(spark, sf_dir):
    return retrieve.bm25(scoped_questions(spark, sf_dir), as_chunks(spark, sf_dir))


@query("bm25_index_topk", f"WITH {_BM25 % 'true'} SELECT query_id, rank::INT AS rank, id, score FROM h WHERE rank <= 5")
def bm25_index_topk(spark, sf_dir):
    """BM25 from a kept index of blocks."""
    kept = InvertedIndex(spark, temporary(spark, "inverted"), buckets=16, id_type="bigint")
    kept.sync(as_chunks(spark, sf_dir))
    return kept.search(as_questions(spark, sf_dir))


_NEWER = "documents WHERE doc_id % 5 <> 0 OR source NOT IN (SELECT source FROM documents WHERE doc_id % 5 <> 0) AND doc_id % 3 <> 0 AND source <> 'src7'"


@query("bm25_index_delta", f"WITH {(_BM25 % 'true').replace('FROM documents)', f'FROM {_NEWER})')} SELECT query_id, rank::INT AS rank, id, score FROM h WHERE rank <= 5")
def bm25_index_delta(spark, sf_dir):
    """BM25 from an index that went from the old version to the new one by deltas."""
    new, old = versions(spark, sf_dir)
    kept = InvertedIndex(spark, temporary(spark, "inverted"), buckets=16, id_type="bigint")
    kept.sync(old)
    kept.sync(new)
    return kept.search(as_questions(spark, sf_dir))


_DENSE = """u AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT vec_id AS query_id, label AS want, e AS x FROM u WHERE mod(vec_id, 20) = 0),
s AS (SELECT query_id, vec_id AS id, round(list_inner_product(x, e) / sqrt(list_inner_product(x, x)) / sqrt(list_inner_product(e, e)), 6) + 0.0 AS score FROM q, u WHERE %s),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)"""


def stored_vectors(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("source"), "embedding")


def query_vectors(spark, sf_dir):
    """The query set of vector searches: every vector whose id is divisible by 20, against all."""
    return load(spark, sf_dir, "embeddings").where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("label").cast("string").alias("source"), "embedding")


@query("dense_topk", f"WITH {_DENSE % 'true'} SELECT query_id, rank::INT AS rank, id, score FROM r WHERE rank <= 5")
def dense_topk(spark, sf_dir):
    return retrieve.dense(query_vectors(spark, sf_dir).drop("source"), stored_vectors(spark, sf_dir))


@query("dense_topk_scoped", f"WITH {_DENSE % 'want = label'} SELECT query_id, rank::INT AS rank, id, score FROM r WHERE rank <= 5")
def dense_topk_scoped(spark, sf_dir):
    return retrieve.dense(query_vectors(spark, sf_dir), stored_vectors(spark, sf_dir))


@query("cells_topk")
def cells_topk(spark, sf_dir):
    """Nearest vectors by cells with the default number of probes; tests hold its recall."""
    rows = stored_vectors(spark, sf_dir)
    centres = cells.learn(rows)
    return cells.search(query_vectors(spark, sf_dir).drop("source"), cells.with_cells(rows, centres), centres)


@query("cells_topk_exact", f"WITH {_DENSE % 'want = label'} SELECT query_id, rank::INT AS rank, id, score FROM r WHERE rank <= 5")
def cells_topk_exact(spark, sf_dir):
    """The same joins of cells with all cells probed, scoped: as exact search gives it."""
    rows = stored_vectors(spark, sf_dir)
    centres = cells.learn(rows, 16)
    return cells.search(query_vectors(spark, sf_dir), cells.with_cells(rows, centres), centres, probes=1.0)


@query(
    "cosine_to_label_mean",
    """WITH e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM e),
    a AS (SELECT label, k, avg(x) AS x FROM x GROUP BY ALL), m AS (SELECT label, list(x ORDER BY k) AS mean FROM a GROUP BY label)
    SELECT id, round(list_cosine_similarity(v, mean), 6) AS cosine FROM e JOIN m USING (label)""",
)
def cosine_to_label_mean(spark, sf_dir):
    """Cosine of each vector and the mean of its label, by array expressions."""
    rows = stored_vectors(spark, sf_dir)
    parts = rows.select("source", F.posexplode("embedding").alias("k", "x")).groupBy("source", "k").agg(F.avg("x").alias("x"))
    means = parts.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda p: p["x"]).alias("mean"))
    return rows.join(settled(means, "means"), "source").select("id", F.round(vectors.dot(vectors.unit(F.col("embedding")), vectors.unit(F.col("mean"))), 6).alias("cosine"))


_RERANK = f"""{_BM25 % 'true'}, c AS (SELECT * FROM h WHERE rank <= {retrieve.CANDIDATES}),
z AS (SELECT c.query_id, c.id, c.rank AS was, list_distinct(regexp_extract_all(lower(b.text), '{W}+')) AS a, list_distinct(regexp_extract_all(lower(d.text), '{W}+')) AS t FROM c JOIN benchmark b ON b.item_id = c.query_id JOIN documents d ON d.doc_id = c.id),
y AS (SELECT query_id, id, was, round(len(list_intersect(a, t)) / greatest(1, len(list_distinct(list_concat(a, t))))::DOUBLE, 6) AS score FROM z),
x AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, was) AS rank FROM y)"""


@query("rerank_topk", f"WITH {_RERANK} SELECT query_id, rank::INT AS rank, id, score FROM x WHERE rank <= 5")
def rerank_topk(spark, sf_dir):
    return retrieve.reranked(retrieve.bm25)(as_questions(spark, sf_dir), as_chunks(spark, sf_dir), 5)


@query("hybrid_registry")
def hybrid_registry(spark, sf_dir):
    """Every registered retriever on the same questions."""
    asked, rows = as_questions(spark, sf_dir), as_chunks(spark, sf_dir)
    out = None
    for name, find in retrieve.registry().items():
        own = find(asked.select("query_id", "query"), rows, 5).withColumn("retriever", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


# ---------------------------------------------------------------- sync


def versions(spark, sf_dir):
    """Two versions of the documents as chunks: the new one has lost a fifth, the old one a third and some sources."""
    docs = load(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("id"), "text")
    return docs.where(F.col("id") % 5 != 0), docs.where((F.col("id") % 3 != 0) & (F.col("source") != "src7"))


_DIFF = """n AS (SELECT DISTINCT source, doc_id AS id FROM documents WHERE doc_id % 5 <> 0), o AS (SELECT DISTINCT source, doc_id AS id FROM documents WHERE doc_id % 3 <> 0 AND source <> 'src7' AND source IN (SELECT source FROM n)),
d AS (SELECT coalesce(n.source, o.source) AS source, coalesce(n.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'add' WHEN n.id IS NULL THEN 'delete' ELSE 'keep' END AS action FROM n FULL JOIN o ON n.source = o.source AND n.id = o.id)"""


@query("sync_diff", f"WITH {_DIFF} SELECT source, id, action FROM d")
def sync_diff(spark, sf_dir):
    return index.sync_diff(*versions(spark, sf_dir))


@query("sync_stats", f"WITH {_DIFF} SELECT count(*) FILTER (action = 'add') AS added, count(*) FILTER (action = 'delete') AS deleted, count(*) FILTER (action = 'keep') AS kept FROM d")
def sync_stats(spark, sf_dir):
    return index.sync_stats(index.sync_diff(*versions(spark, sf_dir)))


@query("sync_dedup", "WITH r AS (SELECT source, substr(sha1(text), 1, 16) AS id, min(doc_id) AS doc_id FROM documents GROUP BY ALL) SELECT source, id, doc_id FROM r")
def sync_dedup(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("source", tx.sha1_prefix(F.col("text")).alias("id"), "doc_id")
    return index.first_of_each(docs, ["doc_id"])[0]


@query("duplicate_ids", "SELECT count(*) - count(DISTINCT (source, sha1(text))) AS duplicates FROM documents")
def duplicate_ids(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("source", tx.sha1_prefix(F.col("text")).alias("id"), "doc_id")
    return index.first_of_each(docs, ["doc_id"])[1]


@query("remove_source", "SELECT source, count(*) AS n, (SELECT count(*) FROM documents WHERE source = 'src3') AS removed FROM documents WHERE source <> 'src3' GROUP BY source")
def remove_source(spark, sf_dir):
    rest, removed = index.without_source(load(spark, sf_dir, "documents").select("source"), "src3")
    return rest.groupBy("source").agg(F.count("*").alias("n")).crossJoin(F.broadcast(removed))  # removed is one row


@query("source_list", "SELECT DISTINCT source FROM documents WHERE source <> ''")
def source_list(spark, sf_dir):
    return index.sources(load(spark, sf_dir, "documents"))


@query(
    "vector_store_sync",
    f"""WITH {_DIFF}, s AS (SELECT count(*) FILTER (action = 'add') AS added, count(*) FILTER (action = 'delete') AS deleted, count(*) FILTER (action = 'keep') AS kept FROM d)
    SELECT 1 AS step, (SELECT count(*) FROM documents WHERE doc_id % 3 <> 0 AND source <> 'src7') AS added, 0 AS deleted, 0 AS kept UNION ALL SELECT 2, added, deleted, kept FROM s UNION ALL SELECT 3, 0, 0, added + kept FROM s""",
)
def vector_store_sync(spark, sf_dir):
    """The old version, then the new one, then the new one again, which changes nothing."""
    new, old = versions(spark, sf_dir)
    store = VectorStore(spark, temporary(spark, "vectors"), vectors.HashEmbedder(), buckets=16)
    form = lambda df: df.select(F.col("id").cast("string").alias("id"), "text", F.struct("source", F.lit("").alias("section"), F.lit(1).alias("page"), F.lit(0).alias("part")).alias("metadata"))
    stats = [store.sync(form(df)) for df in (old, new, new)]
    return spark.createDataFrame([(k, s["added"], s["deleted"], s["kept"]) for k, s in enumerate(stats, 1)], "step int, added long, deleted long, kept long")


# ---------------------------------------------------------------- evaluation


def judged(spark, sf_dir, find=retrieve.bm25, exact=True) -> DataFrame:
    """Hits of each question to DEPTH, judged. exact: evidence counts where it is contained as it stands."""
    asked, rows = as_questions(spark, sf_dir), as_chunks(spark, sf_dir)
    hits = find(asked.select("query_id", "query"), rows, DEPTH)
    if not exact:
        return judge.judge(hits, asked, rows)
    pairs = rows.join(settled(hits, "hits"), "id").join(bounded(asked.select("query_id", "evidence", "relevant")), "query_id")
    a, b = tx.comparable(F.col("evidence")), tx.comparable(F.col("text"))
    return pairs.select("query_id", "rank", "id", "score", ((F.length(a) >= judge.MIN_EVIDENCE) & F.contains(b, a)).alias("hit_evidence"), judge.section_ok(F.col("metadata.source"), F.col("metadata.section"), F.col("relevant")).alias("hit_section"))


def _judged_sql(base: str, table: str) -> str:
    return f"""{base}, j AS (SELECT {table}.query_id, rank, id, score, length({COMPARABLE % 'b.text'}) >= {judge.MIN_EVIDENCE} AND contains({COMPARABLE % 'd.text'}, {COMPARABLE % 'b.text'}) AS hit_evidence,
  d.source = 'src' || (query_id % 20) AND (d.lang = CASE query_id % 2 WHEN 0 THEN 'en' ELSE 'de' END OR starts_with(d.lang, CASE query_id % 2 WHEN 0 THEN 'en > ' ELSE 'de > ' END)) AS hit_section
  FROM {table} JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = id WHERE rank <= {DEPTH})"""


_JUDGED = _judged_sql(_BM25 % "true", "h")
_FIRST = f"{_JUDGED}, first AS (SELECT item_id AS query_id, f FROM benchmark LEFT JOIN (SELECT query_id, min(rank) FILTER (hit_evidence) AS f FROM j GROUP BY 1) ON query_id = item_id)"
_VALUES = f"""{_FIRST}, v AS (SELECT query_id, ['factual', 'conceptual', 'keyword'][query_id % 3 + 1] AS type, 'g' || (query_id % 7) AS "group", unnest(['recall@1', 'recall@5', 'mrr@10']) AS metric,
  unnest([(coalesce(f, 99) <= 1)::INT::DOUBLE, (coalesce(f, 99) <= 5)::INT::DOUBLE, CASE WHEN f <= 10 THEN 1 / f::DOUBLE ELSE 0 END]) AS value FROM first)"""
METRICS = ["recall@1", "recall@5", "mrr@10"]


@query("judge_hits", f"WITH {_JUDGED} SELECT query_id, rank::INT AS rank, id, score, hit_evidence, hit_section FROM j")
def judge_hits(spark, sf_dir):
    return judged(spark, sf_dir)


@query("evidence_exact", f"WITH {_JUDGED} SELECT query_id, id FROM j WHERE hit_evidence")
def evidence_exact(spark, sf_dir):
    return judged(spark, sf_dir).where("hit_evidence").select("query_id", "id")


@query("evidence_fuzzy")
def evidence_fuzzy(spark, sf_dir):
    return judged(spark, sf_dir, exact=False)


@query("section_relevance", f"WITH {_JUDGED} SELECT query_id, count(*) FILTER (hit_section) AS n FROM j GROUP BY query_id")
def section_relevance(spark, sf_dir):
    return judged(spark, sf_dir).groupBy("query_id").agg(F.count(F.when(F.col("hit_section"), 1)).alias("n"))


@query("first_hit", f"WITH {_FIRST} SELECT query_id, f::INT AS first FROM first")
def first_hit(spark, sf_dir):
    firsts = judged(spark, sf_dir).groupBy("query_id").agg(metrics.first_hit(F.col("hit_evidence")).alias("first"))
    return as_questions(spark, sf_dir).select("query_id").join(firsts, "query_id", "left")


def values(spark, sf_dir, find=retrieve.bm25):
    return metrics.metric_values(judged(spark, sf_dir, find), as_questions(spark, sf_dir), METRICS, "hit_evidence", ("type", "group"))


@query("recall_mrr", f"WITH {_VALUES} SELECT metric, count(*) AS n, round(avg(value), 6) AS mean FROM v GROUP BY metric")
def recall_mrr(spark, sf_dir):
    return values(spark, sf_dir).groupBy("metric").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("metrics_by_type", f"WITH {_VALUES} SELECT type, metric, count(*) AS n, round(avg(value), 6) AS mean FROM v GROUP BY ALL")
def metrics_by_type(spark, sf_dir):
    return values(spark, sf_dir).groupBy("type", "metric").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def _boot(source: str, unit: str, value: str = "value", repeats: int = REPEATS) -> str:
    return f"""t AS (SELECT metric, {unit} AS unit, sum({value}) AS s, count(*) AS c FROM {source} GROUP BY ALL),
g AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY unit) - 1 AS g, count(*) OVER (PARTITION BY metric) AS n FROM t),
dr AS (SELECT metric, r AS replicate, ('0x' || substr(md5('0|' || r || '|' || g), 1, 8))::BIGINT % n AS g FROM g, range({repeats}) x(r)),
bo AS (SELECT metric, replicate, sum(s) / sum(c) AS mean FROM dr JOIN g USING (metric, g) GROUP BY ALL)"""


_CI = "SELECT metric, (SELECT count(*) FROM v w WHERE w.metric = bo.metric) AS n, (SELECT round(avg(value), 6) FROM v w WHERE w.metric = bo.metric) AS mean, round(quantile_cont(mean, 0.025), 6) AS lo, round(quantile_cont(mean, 0.975), 6) AS hi FROM bo GROUP BY metric"


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


@query("bootstrap_ci", f"WITH {_VALUES}, {_boot('v', 'query_id::VARCHAR', repeats=metrics.REPEATS)} {_CI}")
def bootstrap_ci(spark, sf_dir):
    return _rounded(metrics.summarize(values(spark, sf_dir), ["metric"], None), "mean", "lo", "hi")


@query("cluster_bootstrap", f'WITH {_VALUES}, {_boot("v", chr(34) + "group" + chr(34))} {_CI}')
def cluster_bootstrap(spark, sf_dir):
    return _rounded(metrics.summarize(values(spark, sf_dir), ["metric"], "group", REPEATS), "mean", "lo", "hi")


_OTHER = _VALUES.replace(_BM25 % "true", f"{_OVERLAP % 'true'}, h AS (SELECT * FROM r)")


@query(
    "paired_bootstrap",
    f"""WITH a AS (WITH {_VALUES} SELECT * FROM v), o AS (WITH {_OTHER} SELECT * FROM v), pd AS (SELECT a.metric, a."group" AS gr, a.value - o.value AS d FROM a JOIN o USING (query_id, metric)), {_boot('pd', 'gr', 'd', metrics.REPEATS)}
    SELECT metric, (SELECT round(avg(d), 6) FROM pd WHERE pd.metric = bo.metric) AS diff, round(quantile_cont(mean, 0.025), 6) AS lo, round(quantile_cont(mean, 0.975), 6) AS hi,
    round(least(1, 2 * least(avg((mean <= 0)::INT), avg((mean >= 0)::INT))), 6) AS p FROM bo GROUP BY metric""",
)
def paired_bootstrap(spark, sf_dir):
    a, b = values(spark, sf_dir), values(spark, sf_dir, retrieve.overlap)
    return _rounded(metrics.paired(a, b, ["metric"], "group"), "diff", "lo", "hi", "p")


@query("bootstrap_generator")
def bootstrap_generator(spark, sf_dir):
    """Intervals drawn by NumPy's generator."""
    return metrics.bootstrap_by(values(spark, sf_dir), ["metric"], "group", REPEATS)


@query("results_roundtrip", f"WITH {_JUDGED} SELECT query_id, count(*)::INT AS n, min(rank) FILTER (hit_evidence)::INT AS first, {DEPTH} AS depth FROM j GROUP BY query_id")
def results_roundtrip(spark, sf_dir):
    asked = as_questions(spark, sf_dir)
    path = temporary(spark, "results") + "/bm25.jsonl"
    saved = judge.results(judged(spark, sf_dir), asked, as_chunks(spark, sf_dir), DEPTH)
    records.write(saved.drop("query_id"), path)
    back = records.read_results(spark, path).join(asked.select("query_id", "query"), "query")
    return back.select("query_id", F.size("scores").alias("n"), F.col("first_hit")["evidence"].alias("first"), "depth")


@query("evaluation_report")
def evaluation_report(spark, sf_dir):
    """The tables of an evaluation of two retrievers in one."""
    asked = as_questions(spark, sf_dir)
    made = evaluate.report({"bm25": judged(spark, sf_dir), "stub": judged(spark, sf_dir, retrieve.overlap)}, asked, "evidence", repeats=REPEATS)
    one = made.summary.select("retriever", F.col("metric").alias("item"), "cell")
    two = made.by_type.select("retriever", F.col("type").alias("item"), "cell")
    three = made.comparison.select("retriever", F.lit("against the first").alias("item"), F.concat_ws(" ", metrics.cell(F.col("diff"), F.col("lo"), F.col("hi")), "verdict").alias("cell"))
    return one.unionByName(two).unionByName(three)


# ---------------------------------------------------------------- confidence

_SIGNALS = f"""{_BM25 % 'true'}, l AS (SELECT query_id, list(score ORDER BY score DESC) AS s FROM h WHERE rank <= 5 GROUP BY 1),
sg AS (SELECT query_id, s[1] AS top1, s[1] - coalesce(s[2], 0) AS margin, s[1] - list_sum(s) / len(s) AS spread FROM l)"""


@query("score_signals", f"WITH {_SIGNALS} SELECT query_id, round(top1, 6) AS top1, round(margin, 6) AS margin, round(spread, 6) AS spread FROM sg")
def score_signals(spark, sf_dir):
    asked = as_questions(spark, sf_dir)
    hits = retrieve.bm25(asked, as_chunks(spark, sf_dir))
    return _rounded(calibrate.hit_signals(hits, asked, 5), "top1", "margin", "spread")


def labelled(spark, sf_dir):
    """Documents with a quality label: x, their length in hundreds of characters; p, a guess from it."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.floor(F.col("n_chars") / 100).cast("double").alias("x"))
    rows = docs.join(load(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("y")), "doc_id")
    return rows.withColumn("p", F.least(F.lit(1.0), (F.col("x") + 1) / 64))


_LABELLED = "z AS (SELECT doc_id, lang, source, floor(n_chars / 100)::DOUBLE AS x, quality = 1 AS y, least(1, (floor(n_chars / 100) + 1) / 64)::DOUBLE AS p FROM documents JOIN labels USING (doc_id))"
_AUROC = "(SELECT {k}, sum(CASE WHEN a.x > b.x THEN 1.0 WHEN a.x = b.x THEN 0.5 ELSE 0 END) / count(*) AS auroc FROM {t} a JOIN {t} b ON {on} WHERE a.y AND NOT b.y GROUP BY {k})"


@query("auroc", f"WITH {_LABELLED} SELECT l.lang, round(auroc, 6) AS auroc FROM (SELECT DISTINCT lang FROM z) l LEFT JOIN {_AUROC.format(k='a.lang', t='z', on='a.lang = b.lang')} r ON r.lang = l.lang")
def auroc(spark, sf_dir):
    return _rounded(calibrate.auroc(labelled(spark, sf_dir), ["lang"]), "auroc")


@query("brier", f"WITH {_LABELLED} SELECT lang, round(avg((p - y::INT) ** 2), 6) AS brier FROM z GROUP BY lang")
def brier(spark, sf_dir):
    return labelled(spark, sf_dir).groupBy("lang").agg(F.round(calibrate.brier(F.col("p"), F.col("y")), 6).alias("brier"))


@query("ece", f"WITH {_LABELLED}, b AS (SELECT lang, least(floor(p * 10), 9) AS bin, count(*) AS n, abs(avg(p) - avg(y::INT)) AS gap FROM z GROUP BY ALL) SELECT lang, round(sum(gap * n) / sum(n), 6) AS ece FROM b GROUP BY lang")
def ece(spark, sf_dir):
    return _rounded(calibrate.ece(labelled(spark, sf_dir), ["lang"]), "ece")


_STEPS = f"""{_LABELLED}, c AS (SELECT lang, x, sum(y::INT) AS s, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY x) AS i FROM z GROUP BY lang, x),
cu AS (SELECT *, sum(s) OVER w AS cs, sum(n) OVER w AS cn FROM c WINDOW w AS (PARTITION BY lang ORDER BY i)),
m AS (SELECT a.lang, a.i AS j, b.i AS k, (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n)::DOUBLE AS mean FROM cu a JOIN cu b ON a.lang = b.lang AND a.i <= b.i),
mi AS (SELECT c.lang, c.i, m.j, min(m.mean) AS low FROM c JOIN m ON m.lang = c.lang AND m.j <= c.i AND m.k >= c.i GROUP BY ALL),
fit AS (SELECT lang, i, round(max(low), 12) AS rate FROM mi GROUP BY ALL),
st AS (SELECT c.lang, min(x) AS x_from, sum(s)::BIGINT AS successes, sum(n)::BIGINT AS n FROM c JOIN fit USING (lang, i) GROUP BY c.lang, rate)"""


@query("isotonic_steps", f"WITH {_STEPS} SELECT lang, x_from, successes, n, round((successes + 1) / (n + 2)::DOUBLE, 6) AS p FROM st")
def isotonic_steps(spark, sf_dir):
    return _rounded(calibrate.isotonic(labelled(spark, sf_dir), ["lang"]), "p")


@query("confidence_lookup", f"""WITH {_STEPS}, a AS (SELECT doc_id, lang, floor(n_chars / 100)::DOUBLE AS x FROM documents), e AS (SELECT lang, min(x_from) AS x0 FROM st GROUP BY 1),
u AS (SELECT doc_id, round((successes + 1) / (n + 2)::DOUBLE, 6) AS p FROM a JOIN e USING (lang) JOIN st ON st.lang = a.lang AND st.x_from = (SELECT max(x_from) FROM st t WHERE t.lang = a.lang AND t.x_from <= greatest(a.x, e.x0)))
SELECT doc_id, p, CASE WHEN p >= 0.8 THEN 'high' WHEN p >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM u""")  # fmt: skip
def confidence_lookup(spark, sf_dir):
    steps = _rounded(calibrate.isotonic(labelled(spark, sf_dir), ["lang"]), "p")
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", F.floor(F.col("n_chars") / 100).cast("double").alias("x"))
    return calibrate.lookup(docs, steps, ["lang"]).select("doc_id", "p", calibrate.level(F.col("p")).alias("level"))


_HOLDOUT = "ks AS (SELECT DISTINCT source FROM documents), kr AS (SELECT source, row_number() OVER (ORDER BY md5('0|' || source), source) <= round_even(count(*) OVER () * 0.3, 0) AS is_test FROM ks)"


@query("group_holdout", f"WITH {_HOLDOUT} SELECT doc_id, is_test FROM documents JOIN kr USING (source)")
def group_holdout(spark, sf_dir):
    return calibrate.holdout(load(spark, sf_dir, "documents").select("doc_id", "source"), "source").select("doc_id", "is_test")


@query("calibration_report", f"""WITH {_LABELLED}, {_HOLDOUT}, a AS (SELECT z.*, is_test FROM z JOIN kr USING (source)), f AS (SELECT is_test, unnest(['length', 'guess']) AS signal, unnest([x, -p]) AS x, y FROM a)
SELECT f.signal, f.is_test, count(*) AS n, round(any_value(auroc), 3) AS auroc FROM f LEFT JOIN (SELECT a.signal, a.is_test, sum(CASE WHEN a.x > b.x THEN 1.0 WHEN a.x = b.x THEN 0.5 ELSE 0 END) / count(*) AS auroc FROM f a JOIN f b ON a.signal = b.signal AND a.is_test = b.is_test WHERE a.y AND NOT b.y GROUP BY ALL) r ON r.signal = f.signal AND r.is_test = f.is_test GROUP BY ALL""")  # fmt: skip
def calibration_report(spark, sf_dir):
    """How well two signals tell good documents, inside and outside the test groups."""
    rows = calibrate.holdout(labelled(spark, sf_dir), "source")
    each = F.explode(F.array(F.struct(F.lit("length").alias("signal"), F.col("x").alias("v")), F.struct(F.lit("guess").alias("signal"), (-F.col("p")).alias("v"))))
    flat = rows.select("is_test", "y", each.alias("e")).select("is_test", "y", "e.signal", F.col("e.v").alias("x"))
    areas = calibrate.auroc(flat, ["signal", "is_test"]).select("signal", "is_test", F.round("auroc", 3).alias("auroc"))
    return flat.groupBy("signal", "is_test").agg(F.count("*").alias("n")).join(areas, ["signal", "is_test"])


@query("confidence_model")
def confidence_model(spark, sf_dir):
    """A model fitted on the questions and its assessment of each."""
    asked = as_questions(spark, sf_dir)
    rows = judged(spark, sf_dir)
    return evaluate.confidence(rows, asked, "bm25").assess(rows, asked)


# ---------------------------------------------------------------- questions and answers


@query("eligible_sections", rf"WITH d AS (SELECT doc_id, {N_WORDS} AS n_words FROM documents) SELECT doc_id, n_words::INT AS n_words FROM d WHERE n_words BETWEEN {questions.MIN_WORDS} AND {questions.MAX_WORDS} AND doc_id % 10 <> 0")
def eligible_sections(spark, sf_dir):
    """Each document is a section; every tenth has a summary above it."""
    path = F.array(F.lit("Chapter 1"), F.when(F.col("doc_id") % 10 == 0, "Chapter Summary").otherwise("Design"))
    return questions.eligible(load(spark, sf_dir, "documents").withColumn("path", path)).select("doc_id", "n_words")


_REPLIES = f"""c AS (SELECT conv_id, turn, text AS query, CASE WHEN turn = 3 THEN 'other' ELSE 'factual' END AS type, {COMPARABLE % 'text'} AS norm, text FROM conversations),
e AS (SELECT *, CASE WHEN {SQUEEZE % 'text'} = '' OR type = 'other' THEN 'malformed' WHEN length(norm) < {judge.MIN_EVIDENCE} THEN 'evidence not in section' END AS r FROM c),
old AS (SELECT DISTINCT {COMPARABLE % 'text'} AS norm FROM benchmark),
k AS (SELECT *, CASE WHEN r IS NULL THEN row_number() OVER (PARTITION BY r IS NULL, norm ORDER BY conv_id, turn, query) END AS n FROM e)"""


def replies(spark, sf_dir):
    """Turns as question rows whose evidence is the turn itself."""
    kind = F.when(F.col("turn") == 3, "other").otherwise("factual")
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", tx.squeeze(F.col("text")).alias("query"), kind.alias("type"), F.col("text").alias("evidence"), F.col("text").alias("section_text"))


def _validated(spark, sf_dir):
    seen = load(spark, sf_dir, "benchmark").select(F.col("text").alias("query"))
    return questions.validate(replies(spark, sf_dir), seen, ["conv_id", "turn", "query"])


@query("question_validation", f"WITH {_REPLIES} SELECT conv_id, turn, coalesce(r, CASE WHEN n > 1 OR norm IN (SELECT norm FROM old) THEN 'duplicate' END) AS reason FROM k")
def question_validation(spark, sf_dir):
    return _validated(spark, sf_dir).select("conv_id", "turn", "reason")


@query("question_dedup", f"WITH {_REPLIES} SELECT conv_id, turn FROM k WHERE r IS NULL AND n = 1 AND norm NOT IN (SELECT norm FROM old)")
def question_dedup(spark, sf_dir):
    return _validated(spark, sf_dir).where("reason IS NULL").select("conv_id", "turn")


@query("fuzzy_validation")
def fuzzy_validation(spark, sf_dir):
    """Items as evidence for the best document of each: most are found nearly or not at all."""
    asked = as_questions(spark, sf_dir)
    best = retrieve.bm25(asked, as_chunks(spark, sf_dir), 1)
    rows = as_chunks(spark, sf_dir).select("id", F.col("text").alias("section_text")).join(settled(best, "hits"), "id").join(bounded(asked), "query_id")
    return questions.validate(rows.select("query_id", "query", "type", "evidence", "section_text"), asked.where("false").select("query"), ["query_id"]).select("query_id", "reason")


_ORDERED = "o AS (SELECT doc_id, source, row_number() OVER (ORDER BY md5('0|' || doc_id), doc_id) AS k FROM documents)"


@query("resume_todo", f"WITH {_ORDERED} SELECT doc_id, k::INT AS ask_order FROM o WHERE k <= 100 AND source || '|1|' || doc_id NOT IN (SELECT source || '|1|' || doc_id FROM o WHERE k % 4 = 0)")
def resume_todo(spark, sf_dir):
    """Of the first hundred sections in the fixed order, those that an earlier run hasn't asked about."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", F.lit(1).alias("page"), F.array(F.col("doc_id").cast("string")).alias("path"))
    rows = questions.in_fixed_order(docs, 100, 0, ("doc_id",))
    progress = rows.where(F.col("ask_order") % 4 == 0).select(questions.section_key().alias("key"))
    return questions.todo(rows, progress).select("doc_id", "ask_order")


@query(
    "citations",
    r"""WITH a AS (SELECT conv_id, turn, text || ' [' || (turn + 1) || '][1, 3; 9] a[i] [' || (conv_id % 11) || ']' AS t FROM conversations),
    g AS (SELECT conv_id, turn, list_sort(list_distinct(list_transform(flatten(list_transform(regexp_extract_all(t, '\[(\d+(?:\s*[,;]\s*\d+)*)\]', 1), lambda x: string_split_regex(x, '\s*[,;]\s*'))), lambda x: x::BIGINT))) AS n FROM a)
    SELECT conv_id, turn, array_to_string(list_filter(n, lambda x: x BETWEEN 1 AND 6), ',') AS cited, array_to_string(list_filter(n, lambda x: NOT x BETWEEN 1 AND 6), ',') AS invalid FROM g""",
)
def citations(spark, sf_dir):
    text = F.concat("text", F.lit(" ["), (F.col("turn") + 1).cast("string"), F.lit("][1, 3; 9] a[i] ["), (F.col("conv_id") % 11).cast("string"), F.lit("]"))
    found = load(spark, sf_dir, "conversations").select("conv_id", "turn", prompt.citations(text, F.lit(answer.MAX_CONTEXT)).alias("c"))
    join = lambda c: F.array_join(F.transform(c, lambda n: n.cast("string")), ",")
    return found.select("conv_id", "turn", join(F.col("c.valid")).alias("cited"), join(F.col("c.invalid")).alias("invalid"))


def listed(spark, sf_dir):
    asked = as_questions(spark, sf_dir)
    rows = as_chunks(spark, sf_dir)
    return answer.hit_lists(retrieve.bm25(asked.select("query_id", "query"), rows), asked, rows)


_LISTED = f"{_BM25 % 'true'}, i AS (SELECT item_id AS query_id, h.rank, h.id, h.score, d.source, d.lang, d.text FROM benchmark LEFT JOIN h ON query_id = item_id AND rank <= 5 LEFT JOIN documents d ON d.doc_id = h.id)"
_BLOCKS = f"""coalesce(string_agg('[' || rank || '] (' || source || ', p. 1)' || chr(10) || {STRIP % 'text'}, chr(10) || chr(10) ORDER BY rank), '')"""


@query("context_block", f"WITH {_LISTED} SELECT query_id, md5({_BLOCKS}) AS context FROM i GROUP BY query_id")
def context_block(spark, sf_dir):
    return listed(spark, sf_dir).select("query_id", F.md5(prompt.context_block(F.col("hits"))).alias("context"))


@query("prompt_messages", f"WITH {_LISTED}, m AS (SELECT query_id, {_BLOCKS} AS c FROM i GROUP BY query_id) SELECT query_id, md5('{prompt.INSTRUCTIONS.replace(chr(39), chr(39) * 2)}') AS system, md5({STRIP % 'text'} || chr(10) || '-----' || chr(10) || c) AS user FROM m JOIN benchmark ON item_id = query_id")
def prompt_messages(spark, sf_dir):
    made = listed(spark, sf_dir).select("query_id", prompt.messages(F.col("query"), prompt.context_block(F.col("hits"))).alias("m"))
    return made.select("query_id", F.md5(F.get("m", F.lit(0))["content"]).alias("system"), F.md5(F.get("m", F.lit(1))["content"]).alias("user"))


@query("answer_gate", f"WITH {_LISTED} SELECT query_id, CASE WHEN count(rank) = 0 THEN 'no_hits' WHEN query_id % 3 = 0 THEN 'low_confidence' ELSE 'llm' END AS route FROM i GROUP BY query_id")
def answer_gate(spark, sf_dir):
    level = F.when(F.col("query_id") % 3 == 0, "low").otherwise("high")
    return listed(spark, sf_dir).select("query_id", answer.route(F.col("hits"), level, True).alias("route"))


_ESCAPED = "replace(replace(replace(replace(replace(%s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(
    "render_hits",
    f"""WITH {_LISTED} SELECT query_id, md5(CASE WHEN count(rank) = 0 THEN '<p>Nothing found.</p>' ELSE '<ol>' ||
    string_agg('<li><article' || CASE WHEN rank = 2 THEN ' data-cited' ELSE '' END || '><h3>' || lang || '</h3><data>' || printf('%.3f', score) || '</data><dl><dt>source</dt><dd>' || source || '</dd><dt>page</dt><dd>1</dd>' ||
    '<dt>part</dt><dd>0</dd><dt>chunk</dt><dd>' || id || '</dd></dl><p>' || {_ESCAPED % 'text'} || '</p></article></li>', '' ORDER BY rank) || '</ol>' END) AS html FROM i GROUP BY query_id""",
)
def render_hits(spark, sf_dir):
    return listed(spark, sf_dir).select("query_id", F.md5(prompt.hit_cards(F.col("hits"), F.array(F.lit(2).cast("bigint")))).alias("html"))


@query("confidence_badge", "SELECT doc_id, CASE quality WHEN 1 THEN 'HIGH' ELSE 'LOW' END || ': one of the first 5 passages answers this with a probability of ' || CASE quality WHEN 1 THEN 85 ELSE 12 END || '%' AS badge FROM labels")
def confidence_badge(spark, sf_dir):
    p = F.when(F.col("quality") == 1, 0.85).otherwise(0.12)
    return load(spark, sf_dir, "labels").select("doc_id", prompt.confidence_badge(calibrate.level(p), p, F.lit(5)).alias("badge"))


@query("answer_text", """SELECT conv_id, turn, md5(CASE WHEN turn % 2 = 0 THEN text || chr(10) || chr(10) || 'Note: there is no passage 7, 9.' || chr(10) || chr(10) || 'Note: no passage is cited.'
  WHEN text = '' THEN '(waiting)' ELSE text || '_' END) AS shown FROM conversations""")  # fmt: skip
def answer_text(spark, sf_dir):
    done = F.col("turn") % 2 == 0
    shown = prompt.answer_text(F.col("text"), done, F.lit(True), F.array().cast("array<bigint>"), F.array(F.lit(7), F.lit(9)))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(shown).alias("shown"))


# ---------------------------------------------------------------- streams


@query("stream_event_counts", "SELECT to_timestamp(floor(epoch(ts) / 300) * 300)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_event_counts(spark, sf_dir):
    """Windowed counts of the events as a stream that is read to its end."""
    from ..streaming.ingest import event_counts

    table, where = f"events_{uuid.uuid4().hex}", temporary(spark, "events")
    schema = load(spark, sf_dir, "events").schema
    source = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(source if _is_folder(spark, source) else f"{source}*")
    counts = event_counts(stream)
    running = counts.writeStream.format("memory").queryName(table).outputMode("complete").option("checkpointLocation", where).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.table(table).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    fs, where = records._fs(spark, path)
    return fs.getFileStatus(where).isDirectory()


@query("stream_sync")
def stream_sync(spark, sf_dir):
    """Documents of each source as a text file; the folder is ingested as a stream into a store of vectors."""
    from ..streaming.ingest import sync_files

    base = temporary(spark, "stream")
    docs = load(spark, sf_dir, "documents")
    rows = docs.select("text", F.col("source").alias("book"), "doc_id")
    with freeing(spark):
        rows.repartition("book").sortWithinPartitions("book", "doc_id").drop("doc_id").write.partitionBy("book").option("lineSep", "\n\n").text(f"{base}/files")
    store = VectorStore(spark, f"{base}/store", vectors.HashEmbedder(), buckets=16)
    sync_files(spark, f"{base}/files", store, f"{base}/checkpoint", source="book=([^/]*)").awaitTermination()
    return store.read().groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and reciprocal rank of BM25 on the items that a document holds as they stand."""
    return recall_mrr(spark, sf_dir).orderBy("metric")
