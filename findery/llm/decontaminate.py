"""Benchmark decontamination by a prefix-filtered set join (operator 3); DataFrame functions only.

A window is WINDOW consecutive words of an item, or the whole item if it has fewer. Each window is a set of
shingles of SHINGLE words (all its words if it has fewer). A text can only contain the window if it contains all its
shingles, so one shingle is a sufficient prefix: the rarest in the documents. The join is on that shingle; the
place of the shingle in the window gives the place of the window in the text, which must lie inside the text
(length and positional bounds); the words at that place are then compared one by one.

Shingles of the benchmark are broadcast if counted to be at most SHINGLE_ROWS hashes; beyond, hashes of the documents'
shingles are shuffled, without words, a shared one over SALTS tasks, and only texts with candidates are read again. The
items of a window are one list, and documents that hit the same lists share one answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WINDOW = 10
SHINGLE = 5
SHINGLE_ROWS = 2_000_000  # of one number each
SALTS = 32
REACH = WINDOW - SHINGLE  # words of a window before its prefix shingle, at most


def words(text: Column) -> Column:
    return common.word_list(common.lower_ascii(text), common.PLAIN_GAP)


def shingle(at: Column, length: int) -> Column:
    return F.xxhash64(F.lit(length), *(F.get("__words", at + k) for k in range(length)))


def item_windows(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """item_id, text -> the distinct windows (window, length, list) and the lists of items (list, items).

    A list is bounded by the items of the benchmark that share a window."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("__words")).where(F.size("__words") > 0)
    last = F.greatest(F.lit(0), F.size("__words") - WINDOW)
    rows = rows.select("item", "__words", F.explode(F.sequence(F.lit(0), last)).alias("__at"))
    rows = rows.select("item", F.slice("__words", F.col("__at") + 1, WINDOW).alias("window"))
    rows = rows.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))
    rows = common.stage(rows.withColumn("list", F.unhex(F.md5(F.to_json("items")))), "windows")
    return rows.select("window", F.size("window").alias("length"), "list"), rows.select("list", "items").dropDuplicates(["list"])


def window_shingles(windows: DataFrame) -> DataFrame:
    """windows -> window, length, list, place, shingle: a row for each shingle of each window."""
    rows = windows.select(F.col("window").alias("__words"), "length", "list")
    rows = rows.withColumn("place", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("length") - SHINGLE))))
    hashed = F.lit(None).cast("long")
    for length in range(1, SHINGLE + 1):
        hashed = F.when(F.least(F.lit(SHINGLE), F.col("length")) == length, shingle(F.col("place"), length)).otherwise(hashed)
    return rows.select(F.col("__words").alias("window"), "length", "list", "place", hashed.alias("shingle"))


def worded(docs: DataFrame) -> DataFrame:
    return docs.select("__row", "doc_id", words(F.col("text")).alias("__words")).withColumn("n_words", F.size("__words"))


def document_shingles(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """worded rows -> a row for each place and length of a shingle (__at, shingle), and one a document at the place
    after its last word, with a null shingle."""
    places = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n_words"))).alias("__at"))
    hashes = [F.when(F.col("__at") + k <= F.col("n_words"), shingle(F.col("__at"), k)) for k in lengths]
    if len(hashes) == 1:
        return places.withColumn("shingle", hashes[0])
    of_document = F.col("__at") == F.col("n_words")
    return places.withColumn("shingle", F.explode(F.when(of_document, F.array(F.lit(None).cast("long"))).otherwise(F.array(*hashes))))


def places_by_broadcast(docs: DataFrame, known: DataFrame, lengths: list[int]) -> DataFrame:
    """Places of the known shingles in docs (__row, place, shingle, start, around: the words from start on), and a row
    a document (__row, doc_id, n_words) with place null. Documents aren't shuffled."""
    hashed = document_shingles(worded(docs), lengths)
    found = hashed.join(F.broadcast(known.withColumnRenamed("shingle", "__known")), F.col("shingle") == F.col("__known"), "left")
    found = found.where(F.col("__known").isNotNull() | (F.col("__at") == F.col("n_words")))
    start = F.greatest(F.lit(0), F.col("__at") - REACH)
    shown = {"place": F.col("__at"), "shingle": F.col("shingle"), "start": start, "around": F.slice("__words", start + 1, F.lit(REACH + WINDOW))}
    return found.select("__row", "doc_id", "n_words", *(F.when(F.col("__known").isNotNull(), c).alias(name) for name, c in shown.items()))


def places_by_shuffle(docs: DataFrame, known: DataFrame, lengths: list[int]) -> DataFrame:
    """The places alone (__row, place, shingle); a shingle that very many documents have is many tasks."""
    hashed = document_shingles(worded(docs), lengths).where(F.col("shingle").isNotNull())
    return salted(hashed.select("__row", F.col("__at").alias("place"), "shingle"), known)


def salted(places: DataFrame, params: DataFrame) -> DataFrame:
    dealt = params.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return places.withColumn("__salt", F.pmod("place", F.lit(SALTS))).join(dealt, ["shingle", "__salt"]).drop("__salt")


def window_hits(docs: DataFrame, items: DataFrame, broadcast: int = SHINGLE_ROWS, repeated: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs (__row, doc_id, text) -> a row a document (__row, doc_id, n_words), the occurrences of windows (__row,
    first, end, list), and the lists of items (list, items). Rows that may share their __row (repeated) have one text."""
    windows, lists = item_windows(items)
    shingles = common.stage(window_shingles(windows), "shingles")
    lengths = [r[0] for r in shingles.select(F.least(F.lit(SHINGLE), "length")).distinct().collect()]  # five at most
    lengths = sorted(lengths) or [SHINGLE]
    known = shingles.select("shingle").distinct()
    if known.limit(broadcast + 1).count() <= broadcast:
        found = common.stage(places_by_broadcast(docs, known, lengths), "places")
        each = found.where(F.col("place").isNull()).select("__row", "doc_id", F.col("n_words").cast("long").alias("n_words"))
        places = found.where(F.col("place").isNotNull()).select("__row", "place", "shingle", "start", "around", "n_words")
    else:
        found, docs = None, common.stage(docs.dropDuplicates(["__row"]) if repeated else docs, "numbered")
        each = worded(docs).select("__row", "doc_id", F.col("n_words").cast("long").alias("n_words"))
        places = common.stage(places_by_shuffle(docs, known, lengths), "places")

    frequency = places.groupBy("shingle").agg(F.count("*").alias("__df"))
    ranked = shingles.join(frequency, "shingle")  # a window with a shingle that no document has can't occur
    whole = F.greatest(F.lit(1), F.col("length") - SHINGLE + 1)
    prefix = ranked.groupBy("window", "length", "list").agg(F.min(F.struct("__df", "shingle", "place")).alias("__first"), F.count("*").alias("__seen")).where(F.col("__seen") == whole)
    prefix = prefix.select("window", "length", "list", F.col("__first.shingle").alias("shingle"), F.col("__first.place").alias("offset"))
    prefix = common.stage(prefix, "prefixes")

    first = F.col("place") - F.col("offset")
    if prefix.limit(common.BROADCAST_ROWS + 1).count() <= common.BROADCAST_ROWS:
        candidates = places.join(F.broadcast(prefix), "shingle")
    else:
        candidates = salted(places, prefix)
    candidates = candidates.withColumn("first", first).where("first >= 0")
    if found is not None:
        same = (F.col("first") + F.col("length") <= F.col("n_words")) & (F.slice("around", F.col("first") - F.col("start") + 1, F.col("length")) == F.col("window"))
    else:
        candidates = candidates.select("__row", "first", "length", "list", "window").join(worded(docs).select("__row", "__words", "n_words"), "__row")
        same = (F.col("first") + F.col("length") <= F.col("n_words")) & (F.slice("__words", F.col("first") + 1, F.col("length")) == F.col("window"))
    hits = candidates.where(same).select("__row", "first", (F.col("first") + F.col("length")).alias("end"), "list")
    return each, common.stage(hits, "hits"), lists


def answers(hits: DataFrame, lists: DataFrame) -> DataFrame:
    """hits -> __row, n_items, items_sha256. Rows with the same lists of items are answered once."""
    per = hits.groupBy("__row").agg(F.sort_array(F.collect_set("list")).alias("lists"))
    per = common.stage(per.withColumn("kind", F.unhex(F.md5(F.concat_ws(",", F.transform("lists", F.hex))))), "hit-lists")
    kinds = per.groupBy("kind").agg(F.first("lists").alias("lists"), F.count("*").alias("n"))
    named = kinds.select("kind", "n", F.explode("lists").alias("list")).join(lists, "list").select("kind", "n", F.explode("items").alias("item"))
    named = named.groupBy("kind").agg(F.first("n").alias("n"), F.array_sort(F.collect_set("item")).alias("ids"))
    known = named.select("kind", "n", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    return common.join_hot(per.select("__row", "kind"), common.stage(known, "answers"), "kind", "n").select("__row", "n_items", "items_sha256")


def contamination(docs: DataFrame, items: DataFrame, broadcast: int = SHINGLE_ROWS) -> DataFrame:
    """One row a row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words; items without words have no windows; repeated items count once by their
    item_id as a string (a null one is the empty string). Rows of docs with equal or null ids stay apart."""
    each, hits, lists = window_hits(docs.select("doc_id", "text").withColumn("__row", F.monotonically_increasing_id()), items, broadcast)
    ordered = Window.partitionBy("__row").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.groupBy("__row", "first").agg(F.max("end").alias("end")).withColumn("__past", F.max("end").over(ordered))
    covered = spans.groupBy("__row").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("first", F.coalesce("__past", F.lit(0))))).alias("n_hit"))
    out = each.join(covered, "__row", "left").join(answers(hits, lists), "__row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    none = F.sha2(F.lit(""), 256)
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, broadcast: int = SHINGLE_ROWS) -> DataFrame:
    """docs without those that have a word in an occurrence of a window; rows are told apart by their texts, so
    equal texts share their fate and ids don't matter. Null and empty texts stay."""
    key = common.free_name(docs, "text_key")
    keyed = docs.withColumn(key, F.unhex(F.md5("text")))
    _, hits, _ = window_hits(keyed.select(F.col(key).alias("doc_id"), "text").withColumn("__row", F.col("doc_id")), items, broadcast, repeated=True)
    hit = hits.select(F.col("__row").alias("__hit")).distinct()
    return keyed.join(common.small(hit), F.col(key) == F.col("__hit"), "left_anti").select(*docs.columns)


def op3_prefix_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return contamination(common.load(spark, sf_dir, "documents"), common.load(spark, sf_dir, "benchmark"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS t FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM wins),
places AS (SELECT r, w, n, unnest(range(1, greatest(0, len(w) - n + 1) + 1)) AS i FROM d, lens),
grams AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS t FROM places),
hits AS (SELECT g.r, g.n, g.i, wins.item FROM grams g JOIN wins ON g.t = wins.t AND g.n = wins.n),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
listed AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(l.n_items, 0)::BIGINT AS n_items, sha256(coalesce(l.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c USING (r) LEFT JOIN listed l USING (r)
"""
