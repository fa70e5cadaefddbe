"""Resolution of not-modified revisits in a capture log (operator 2).

A revisit says that a page was as in an earlier response, which holds the body. Each one is joined, as of its time,
with the latest earlier full response of its canonical URL; the validators are checked (entity tag, else time of
last modification), and the headers that a not-modified answer may change are merged over those of the original.

Captures are dealt out by ranges of URL and time that hold about as many rows each, so a URL with very many captures
is several slices, whatever its times are. The as-of join is two windows: one inside a slice of a URL, and one over a
row for each slice of a URL, which carries the latest response of the slices before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Headers that a not-modified answer may update.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that don't change what a URL names.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=.*)?$"
PARTS = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?]*)([^?]*)\??(.*)$"


def canonical(url: Column) -> Column:
    """Without scheme, fragment, www., default port, tracking parameters and final slashes; host in lower case,
    parameters in order."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, PARTS, 1)), ":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, PARTS, 2), "/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(bare, PARTS, 3), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def resolve(records: DataFrame, slices: int | None = None) -> DataFrame:
    """records (record_id, url, ts long, status int, etag, last_modified, headers array<struct<name,value>>,
    n_bytes) -> one row a revisit (status 304): record_id, url_key, status, original_id, validator, n_bytes, headers.

    status is resolved, mismatch (a validator differs), unchecked (no validator to compare) or missing (no earlier
    full response; also for a null url or ts). Earlier means a lesser ts; of equal ones the greatest record_id is the
    latest. Responses without ts are never original. headers are lines by lower-cased name; lines of a repeated name all
    stay, in their order, and those of a permitted name in the revisit replace all of that name. Other columns are
    left out. slices is the number of ranges, that of shuffle partitions if None."""
    given = ["record_id", "url", "ts", "status", "etag", "last_modified", "headers", "n_bytes"]
    rows = records.select(*given).where("status IN (200, 304)").withColumn("url_key", canonical(F.col("url")))
    full = F.when((F.col("status") == 200) & F.col("ts").isNotNull(), F.struct("ts", "record_id", "etag", "last_modified", "n_bytes", "headers"))
    rows = rows.select("record_id", "url_key", "ts", "status", "etag", "last_modified", "headers", full.alias("full"))
    ranged = rows.repartitionByRange(*([slices] if slices else []), "url_key", "ts")  # equal times of a URL stay together
    rows = common.stage(ranged.withColumn("slice", F.spark_partition_id()), "captures")

    inside = Window.partitionBy("url_key", "slice").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("near", F.max("full").over(inside)).where("status = 304")
    by_slice = rows.where(F.col("full").isNotNull() & F.col("url_key").isNotNull()).groupBy("url_key", "slice").agg(F.max("full").alias("last"))
    asked = near.where(F.col("near").isNull() & F.col("url_key").isNotNull()).select("url_key", "slice").distinct().withColumn("last", F.lit(None).cast(by_slice.schema["last"].dataType))
    before = Window.partitionBy("url_key").orderBy("slice").rangeBetween(Window.unboundedPreceding, -1)
    carried = by_slice.unionByName(asked).withColumn("far", F.max("last").over(before)).groupBy("url_key", "slice").agg(F.max("far").alias("far"))
    found = near.join(carried, ["url_key", "slice"], "left").withColumn("o", F.when(F.col("url_key").isNotNull() & F.col("ts").isNotNull(), F.coalesce("near", "far")))

    strong = lambda tag: F.regexp_replace(tag, "^W/", "")
    tagged = F.col("etag").isNotNull() & F.col("o.etag").isNotNull()
    dated = F.col("last_modified").isNotNull() & F.col("o.last_modified").isNotNull()
    validator = F.when(F.col("o").isNull(), None).when(tagged, "etag").when(dated, "last_modified")
    same = F.when(tagged, strong(F.col("etag")) == strong(F.col("o.etag"))).when(dated, F.col("last_modified") == F.col("o.last_modified"))
    status = F.when(F.col("o").isNull(), "missing").when(same.isNull(), "unchecked").when(same, "resolved").otherwise("mismatch")
    usable = status.isin("resolved", "unchecked")
    return found.select("record_id", "url_key", status.alias("status"), F.col("o.record_id").alias("original_id"), validator.alias("validator"), F.when(usable, F.col("o.n_bytes")).alias("n_bytes"), F.when(usable, merged(F.col("o.headers"), F.col("headers"))).alias("headers"))


def merged(original: Column, update: Column) -> Column:
    """Headers of the original with the permitted ones of the update in their place, as lines by name, then by place."""
    none = F.array().cast("array<struct<name:string,value:string>>")
    lower = lambda rows: F.transform(F.filter(F.coalesce(rows, none), lambda h: h["name"].isNotNull()), lambda h: F.struct(F.lower(h["name"]).alias("name"), F.coalesce(h["value"], F.lit("")).alias("value")))
    new = F.filter(lower(update), lambda h: h["name"].isin(*PERMITTED))
    names = F.transform(new, lambda h: h["name"])
    kept = F.filter(lower(original), lambda h: ~F.array_contains(names, h["name"]))
    placed = F.transform(F.concat(kept, new), lambda h, i: F.struct(h["name"].alias("name"), i.alias("at"), h["value"].alias("value")))
    return F.array_join(F.transform(F.array_sort(placed), lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n")


def attach_payload(resolved: DataFrame, records: DataFrame, body: str) -> DataFrame:
    """resolved with the body of the original response, by its record_id."""
    return resolved.join(records.select(F.col("record_id").alias("original_id"), body), "original_id", "left")


def captures(pages: DataFrame) -> DataFrame:
    """A capture log made from pages: each page is a full response at 1000 times its page_id; revisits of it, under
    another spelling of its URL, follow for three of four pages, one with the right entity tag, one with the right
    date only, one with a stale tag; the fourth has a revisit before its response."""
    number = lambda text: F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("long")
    kind = number(F.col("page_id").cast("string")) % 4
    etag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    modified = F.concat(F.lit("day "), (F.col("page_id") % 365).cast("string"))
    header = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    n_bytes = F.octet_length(F.coalesce("html", F.lit(""))).cast("long")
    full_headers = F.array(header("Content-Type", F.lit("text/html")), header("Content-Length", n_bytes), header("ETag", etag), header("Date", F.col("page_id")), header("Cache-Control", F.lit("max-age=60")))
    full = pages.select((F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 1000).alias("ts"), F.lit(200).alias("status"), etag.alias("etag"), modified.alias("last_modified"), full_headers.alias("headers"), n_bytes.alias("n_bytes"))
    later = F.col("page_id") * 1000 + F.when(kind == 3, -7).otherwise(number(F.col("url")) % 50_000 + 1)
    spelled = F.concat(F.regexp_replace("url", "^https?://", "HTTPS://"), F.when(F.col("url").contains("?") | F.col("url").contains("#"), "").otherwise("?utm_medium=again"))
    tag = F.when(kind == 0, F.concat(F.lit("W/"), etag)).when(kind == 2, F.lit('"stale"')).when(kind == 3, etag)
    seen_headers = F.array(header("Date", later), header("ETag", F.coalesce(tag, etag)), header("Content-Length", F.lit(0)), header("Expires", F.lit("never")))
    seen = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), spelled.alias("url"), later.alias("ts"), F.lit(304).alias("status"), tag.alias("etag"), modified.alias("last_modified"), seen_headers.alias("headers"), F.lit(0).cast("long").alias("n_bytes"))
    return full.unionByName(seen)


def op2_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve(captures(common.load(spark, sf_dir, "pages")))


_CANONICAL = rf"""regexp_replace(regexp_replace(lower(regexp_extract(bare, '{PARTS}', 1)), ':(80|443)$', ''), '^www\.', '') || regexp_replace(regexp_extract(bare, '{PARTS}', 2), '/+$', '')
  || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END"""
_KEYED = rf"""SELECT *, {_CANONICAL} AS url_key FROM (SELECT *, list_sort(list_filter(string_split(regexp_extract(bare, '{PARTS}', 3), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{TRACKING}'))) AS q
  FROM (SELECT *, regexp_replace(trim(url), '#.*$', '') AS bare FROM %s))"""
SQL = rf"""
WITH p AS (SELECT *, '"' || md5(coalesce(html, '')) || '"' AS tag, 'day ' || (page_id % 365) AS modified, strlen(coalesce(html, ''))::BIGINT AS nb,
  ('0x' || substr(md5(page_id::VARCHAR), 1, 6))::BIGINT % 4 AS kind, ('0x' || substr(md5(url), 1, 6))::BIGINT % 50000 + 1 AS wait FROM pages),
full_ AS (SELECT page_id * 2 AS record_id, url, page_id * 1000 AS ts, tag, modified, nb FROM p),
seen AS (SELECT page_id * 2 + 1 AS record_id, regexp_replace(url, '^https?://', 'HTTPS://') || CASE WHEN contains(url, '?') OR contains(url, '#') THEN '' ELSE '?utm_medium=again' END AS url,
  page_id * 1000 + CASE WHEN kind = 3 THEN -7 ELSE wait END AS ts, CASE kind WHEN 0 THEN 'W/' || tag WHEN 2 THEN '"stale"' WHEN 3 THEN tag END AS etag, tag AS own, modified FROM p),
f AS ({_KEYED % "full_"}), s AS ({_KEYED % "seen"}),
m AS (SELECT s.*, f.record_id AS o, f.tag AS o_tag, f.modified AS o_modified, f.nb AS o_nb, f.ts AS o_ts,
  row_number() OVER (PARTITION BY s.record_id ORDER BY f.ts DESC NULLS LAST, f.record_id DESC) AS k FROM s LEFT JOIN f ON f.url_key = s.url_key AND f.ts < s.ts),
r AS (SELECT *, CASE WHEN o IS NULL THEN 'missing' WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = o_tag THEN 'resolved' ELSE 'mismatch' END
  WHEN modified = o_modified THEN 'resolved' ELSE 'mismatch' END AS status FROM m WHERE k = 1)
SELECT record_id, url_key, status, o AS original_id, CASE WHEN o IS NULL THEN NULL WHEN etag IS NOT NULL THEN 'etag' ELSE 'last_modified' END AS validator,
  CASE WHEN status = 'resolved' THEN o_nb END AS n_bytes,
  CASE WHEN status = 'resolved' THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || o_nb || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10) || 'etag: ' || coalesce(etag, own) || chr(10) || 'expires: never' END AS headers FROM r
"""


def brute(records: list[dict]) -> list[tuple]:
    """Each revisit against all responses, on rows with url_key, for tests: record_id, status, original_id."""
    out = []
    for r in records:
        if r["status"] != 304:
            continue
        old = [o for o in records if o["status"] == 200 and o["ts"] is not None and r["ts"] is not None and o["url_key"] is not None and o["url_key"] == r["url_key"] and o["ts"] < r["ts"]]
        best = max(old, key=lambda o: (o["ts"], o["record_id"]), default=None)
        if best is None:
            out.append((r["record_id"], "missing", None))
            continue
        pairs = [(r[k], best[k]) for k in ("etag", "last_modified") if r[k] is not None and best[k] is not None]
        bare = [tuple(v.removeprefix("W/") for v in p) for p in pairs[:1]]
        out.append((r["record_id"], "unchecked" if not bare else "resolved" if bare[0][0] == bare[0][1] else "mismatch", best["record_id"]))
    return out
