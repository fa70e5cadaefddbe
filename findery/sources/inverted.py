"""A kept inverted index for BM25 that follows its chunks by deltas.

A sync adds one segment: the postings of new chunks, and signed rows, plus for new and minus for removed chunks, from
which document frequencies, the number of chunks and their mean length are sums. Of what is there it reads the signed rows of
the buckets that change, and the postings of the blocks that lose chunks. Texts are inverted where they are read.

Postings lie in blocks: a row has the places in one block of the chunks with one term, the greatest frequency and the least
length among them, which bound what the term can add to a score there, whatever the mean length is by then. Which chunks have
the places is one more row a block. A search first scores the most promising blocks of each query, and of the others only
those whose bound reaches the k-th score; the words of a block that are asked for meet in one task, which keeps the best hits."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import index, retrieve
from ..session import PACKED, bounded, freeing, settled, stage
from .notes import Notes

BUCKETS, BLOCK = 64, 64
LAYOUT = 2  # of the tables
FIRST = 8  # blocks of a query that are scored to know its k-th score
LISTED = 1000  # terms of queries up to which files are also pruned by their list
POOL = 1 << 20  # postings that are dealt to blocks at a time, about, and
DENSE = 1 << 17  # those that close a block of fewer chunks
MEMBERS = -1  # the bucket of the rows that say which chunks a block has; those have no term
FORWARD = "id {id}, source string, n_words int, sign int"
POSTED = "term string, block long, max_tf int, min_words int, n int, slots array<tinyint>, tfs array<int>, ids array<{id}>, sources array<string>, n_words array<int>"
SUMS = "term string, df long"


def forward(chunks: DataFrame) -> DataFrame:
    """id, source, n_words, terms (term, tf): a row a chunk (id, source, text). A null source is the empty one."""
    words = F.coalesce(tx.tokens(F.col("text")), F.array().cast("array<string>"))
    rows = chunks.select("id", F.coalesce("source", F.lit("")).alias("source"), F.array_sort(words).alias("w"))
    heads = F.filter(F.transform("w", lambda x, i: F.struct(x.alias("term"), i.alias("at"), ((i == 0) | (x != F.get("w", i - 1))).alias("head"))), lambda s: s["head"])
    rows = rows.withColumn("heads", heads)
    after = F.slice("heads", 2, F.greatest(F.size("heads"), F.lit(1)))
    ends = F.zip_with("heads", after, lambda s, e: F.struct(s["term"].alias("term"), (F.coalesce(e["at"], F.size("w")) - s["at"]).cast("int").alias("tf")))
    return rows.select("id", "source", F.size("w").alias("n_words"), ends.alias("terms"))


def posted(rows: DataFrame, per_block: int = BLOCK, pool: int = POOL) -> DataFrame:
    """POSTED of forward rows. A chunk is in one block with all its terms. Each task deals its rows to blocks, a pool at a
    time by length, as lengths bound scores; nothing is shuffled."""

    def invert(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32

        def table(n, columns):
            arrays = [columns.get(f.name, None) for f in fields]
            return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if a is None else a.cast(f.type) for a, f in zip(arrays, fields, strict=True)], schema=pa.schema(fields))

        def blocks(held):
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            lists, words = whole.column("terms"), whole.column("n_words").to_numpy()
            sizes = lists.value_lengths().to_numpy()
            order = np.argsort(words, kind="stable")
            ends, n = [], 0
            for at, size in enumerate(sizes[order].tolist()):
                if at and (at - (ends[-1] if ends else 0) == per_block or n + size > DENSE):
                    ends.append(at)
                    n = 0
                n += size
            starts = np.array([0, *ends])
            number = np.searchsorted(starts, np.arange(len(order)), "right") - 1
            of, slot = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
            of[order], slot[order] = number, np.arange(len(order)) - starts[number]
            listed = lambda at, values: pa.ListArray.from_arrays(pa.array(np.append(at, len(values)).astype(np.int32)), values)
            chunk = whole.take(pa.array(order))
            yield table(len(starts), {"block": pa.array(block + np.arange(len(starts))), "ids": listed(starts, chunk.column("id")), "sources": listed(starts, chunk.column("source")), "n_words": listed(starts, chunk.column("n_words"))})
            flat = lists.flatten()
            if len(flat):
                doc, tf = np.repeat(np.arange(len(sizes)), sizes), pc.struct_field(flat, "tf").to_numpy()
                found = pc.struct_field(flat, "term").dictionary_encode()
                codes = found.indices.to_numpy().astype(np.int64) * len(starts) + of[doc]
                order = np.argsort(codes, kind="stable")
                codes, tf, doc = codes[order], tf[order], doc[order]
                heads = np.flatnonzero(np.diff(codes, prepend=-1))
                rows = table(len(heads), {
                    "term": found.dictionary.take(pa.array(codes[heads] // len(starts))), "block": pa.array(block + codes[heads] % len(starts)), "max_tf": pa.array(np.maximum.reduceat(tf, heads)),
                    "min_words": pa.array(np.minimum.reduceat(words[doc], heads)), "n": pa.array(np.diff(heads, append=len(codes))), "slots": listed(heads, pa.array(slot[doc].astype(np.int8))), "tfs": listed(heads, pa.array(tf)),
                })
                yield from (rows.slice(at, 1 << 16) for at in range(0, len(heads), 1 << 16))
            return len(starts)

        held, n, fields = [], 0, None
        for batch in batches:
            text, id_kind, listed = pa.string(), batch.schema.field("id").type, pa.list_
            fields = [pa.field(*f) for f in (
                ("term", text), ("block", pa.int64()), ("max_tf", pa.int32()), ("min_words", pa.int32()), ("n", pa.int32()), ("slots", listed(pa.int8())), ("tfs", listed(pa.int32())),
                ("ids", listed(id_kind)), ("sources", listed(text)), ("n_words", listed(pa.int32())),
            )]
            upto, at = np.cumsum(batch.column("terms").value_lengths().to_numpy()), 0
            while at < len(upto):
                before = upto[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(upto, before + pool - n, "right")))
                held.append(batch.slice(at, end - at))
                n, at = n + upto[end - 1] - before, end
                if n >= pool or at < len(upto):
                    block += yield from blocks(held)
                    held, n = [], 0
        if held:
            yield from blocks(held)

    return rows.mapInArrow(invert, POSTED.replace("{id}", rows.schema["id"].dataType.simpleString()))


def chunk_rows(blocks: DataFrame) -> DataFrame:
    """id, source, n_words, terms, tf, as retrieve.best_hits takes them, of blocks (words, an array of t, slots and tfs; ids,
    sources, n_words; gone, the places that don't count, or null). Chunks without words go."""

    def turn(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            ids, words = batch.column("ids"), batch.column("words")
            base = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())])
            flat = words.flatten()
            slots, t = pc.struct_field(flat, "slots"), pc.struct_field(flat, "t").to_numpy()
            n = slots.value_lengths().to_numpy()
            chunk = np.repeat(np.repeat(base[:-1], words.value_lengths().to_numpy()), n) + slots.flatten().to_numpy()
            order = np.argsort(chunk, kind="stable")
            offsets = pa.array(np.searchsorted(chunk[order], np.arange(base[-1] + 1)).astype(np.int32))
            listed = lambda v, o=offsets: pa.ListArray.from_arrays(o, pa.array(v.astype(np.int32)))
            tfs = pc.struct_field(flat, "tfs").flatten().to_numpy()
            keep = np.diff(offsets.to_numpy()) > 0
            gone = batch.column("gone")
            keep[np.repeat(base[:-1], gone.value_lengths().fill_null(0).to_numpy()) + gone.flatten().to_numpy()] = False
            out = pa.RecordBatch.from_arrays(
                [ids.flatten(), batch.column("sources").flatten(), batch.column("n_words").flatten(), listed(np.repeat(t, n)[order]), listed(tfs[order])],
                names=["id", "source", "n_words", "terms", "tf"],
            )
            yield out.filter(pa.array(keep))

    id_kind = blocks.schema["ids"].dataType.elementType.simpleString()
    return blocks.select("words", "ids", "sources", "n_words", "gone").mapInArrow(turn, f"id {id_kind}, source string, n_words int, terms array<int>, tf array<int>")


def part(idf: Column, tf: Column, n_words: Column, mean: float, k1: float, b: float) -> Column:
    """What a term adds to a score; more for a greater frequency, less for a greater length."""
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * n_words / mean))


@dataclass
class Candidates:
    """bounds: query_id, segment, block, bound, and n, the postings there; opening and rest: the blocks that are scored;
    found: query_id, id, score of their chunks."""

    bounds: DataFrame
    opening: DataFrame
    rest: DataFrame
    found: DataFrame

    def postings(self) -> tuple[int, int]:
        """How many postings are read, and how many the words of the queries have."""
        whole = lambda df: df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
        read = self.opening.unionByName(self.rest)
        return whole(self.bounds.join(read, read.columns, "left_semi")), whole(self.bounds)


class InvertedIndex:
    """Segments under a folder that driver and executors share. A segment counts from the moment that its note is there,
    which of two writers one can put."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS, id_type: str = "string"):
        self.spark, self.path = spark, folder.rstrip("/")
        self.notes = Notes(spark, self.path)
        self.notes.put("index", {"buckets": buckets, "id_type": id_type, "layout": LAYOUT})
        told = self.notes.read("index")  # that of the first who opened it
        if told.get("layout") != LAYOUT:
            raise ValueError(f"{self.path} is of an earlier layout; it must be made anew")
        self.buckets, self.id_type = told["buckets"], told["id_type"]

    def _bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(name, F.lit(""))), F.lit(self.buckets)).cast("int")

    def _segments(self) -> list[dict]:
        return [self.notes.read(f"segments/{n}") for n in self.notes.names("segments")]

    def _table(self, kind: str, schema: str, segments: list[dict], buckets: list[int] | None = None) -> DataFrame:
        """A table of the segments, with the number of each; of some buckets only."""
        schema = schema.replace("{id}", self.id_type)
        wanted = [s for s in segments if s[kind]]
        if not wanted:
            return self.spark.createDataFrame([], f"{schema}, segment string, bucket int")
        rows = self.spark.read.schema(f"{schema}, segment string, bucket int").option("basePath", f"{self.path}/{kind}").parquet(*(f"{self.path}/{kind}/segment={s['name']}" for s in wanted))
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def _known(self, segments: list[dict], buckets: list[int]) -> DataFrame:
        """FORWARD rows of the chunks that are there, of some buckets of sources, and the segment of each."""
        rows = self._table("forward", FORWARD, segments, buckets)
        last = F.row_number().over(Window.partitionBy("source", "id").orderBy(F.desc("segment")))
        return rows.withColumn("last", last).where("last = 1 AND sign > 0").drop("last", "bucket")

    def _members(self, segments: list[dict]) -> DataFrame:
        """segment, block, ids, sources, n_words of the blocks."""
        return self._table("blocks", POSTED, segments, [MEMBERS]).select("segment", "block", "ids", "sources", "n_words")

    def _places(self, segments: list[dict], gone: DataFrame, on: Callable[[Column, Column], Column]) -> DataFrame:
        """segment, block, gone: the places of chunks (id, source, segment) in the blocks of the segments that on, of a block's
        segment and a chunk's, allows."""
        each = self._members(segments).select("segment", "block", F.posexplode(F.arrays_zip("ids", "sources")).alias("slot", "c"))
        gone = bounded(gone.select(F.col("id").alias("gone_id"), F.col("source").alias("gone_source"), F.col("segment").alias("gone_segment")))
        same = (F.col("c.ids") == F.col("gone_id")) & (F.col("c.sources") == F.col("gone_source")) & on(F.col("segment"), F.col("gone_segment"))
        return each.join(gone, same).groupBy("segment", "block").agg(F.collect_list(F.col("slot").cast("tinyint")).alias("gone"))

    def sync(self, chunks: DataFrame) -> dict[str, int]:
        """Makes the index hold exactly the chunks (id, source, text) of every source that they cover; other sources stay.
        A chunk is known by source and id, of which repeated ones the first text counts. A second call changes nothing.
        chunks are computed more than once, their texts as often as they are inverted."""
        rows = chunks.select(F.col("id").cast(self.id_type).alias("id"), F.coalesce("source", F.lit("")).alias("source"), "text").where("id IS NOT NULL")
        keys = stage(rows.groupBy("source", "id").agg(F.count("*").alias("n")), "keys")
        segments, key = self._segments(), ["source", "id"]
        buckets = [r[0] for r in keys.select(self._bucket("source")).distinct().collect()]
        known = self._known(segments, buckets)
        diff = stage(index.sync_diff(keys, known), "diff")
        stats = index.sync_stats(diff).first()
        new = forward(index.added(index.one_of_each(rows, keys, ["text"]), diff)) if stats.added else None
        gone = known.join(bounded(diff.where("action = 'delete'").select(*key)), key, "left_semi") if stats.deleted else None
        return self._append(segments, new, gone) | {"kept": stats.kept}

    def remove_source(self, source: str) -> int:
        """Takes away the chunks of a source; how many there were."""
        segments = self._segments()
        buckets = [self.spark.range(1).select(F.lit(source).alias("s")).select(self._bucket("s")).first()[0]]
        return self._append(segments, None, self._known(segments, buckets).where(F.col("source") == source))["deleted"]

    def _append(self, segments: list[dict], new: DataFrame | None, gone: DataFrame | None) -> dict[str, int]:
        """One more segment: the postings of new, rows of forward(), and signed rows and sums of these and of gone, rows of
        _known()."""
        number = segments[-1]["number"] + 1 if segments else 1
        name, made = f"{number:012d}-{uuid.uuid4().hex}", []
        signed, sums = [], []

        def write(kind: str, rows: DataFrame, *order: str) -> None:
            made.append(kind)
            with freeing(self.spark):
                rows.sortWithinPartitions("bucket", *order).write.option("compression", PACKED).partitionBy("bucket").parquet(f"{self.path}/{kind}/segment={name}")

        if new is not None:
            rows = posted(new)
            write("blocks", rows.withColumn("bucket", F.when(F.col("term").isNull(), MEMBERS).otherwise(self._bucket("term"))), "term", "block")
            own = [{"name": name, "blocks": True}]
            each = self._members(own).select(F.explode(F.arrays_zip("ids", "sources", "n_words")).alias("c"))
            signed.append(each.select(F.col("c.ids").alias("id"), F.col("c.sources").alias("source"), F.col("c.n_words").alias("n_words"), F.lit(1).alias("sign")))
            sums.append(self._table("blocks", POSTED, own).where(F.col("bucket") != MEMBERS).groupBy("term").agg(F.sum("n").alias("df")))
        if gone is not None:
            gone = stage(gone, "gone")
            signed.append(gone.select("id", "source", "n_words", F.lit(-1).alias("sign")))
            places = settled(self._places(segments, gone, lambda block, chunk: block == chunk), "places")
            lost = self._table("blocks", POSTED, segments).where(F.col("bucket") != MEMBERS).join(places, ["segment", "block"])
            sums.append(lost.groupBy("term").agg((-F.sum(F.size(F.array_intersect("slots", "gone")))).alias("df")))
        done = {"added": 0, "deleted": 0}
        if not signed:
            return done
        rows = reduce(DataFrame.unionByName, signed).withColumn("bucket", self._bucket("source"))
        write("forward", rows.repartition("bucket", F.pmod(F.xxhash64("source", "id"), F.lit(8))), "source", "id")  # a bucket isn't one task
        rows = reduce(DataFrame.unionByName, sums).groupBy("term").agg(F.sum("df").cast("long").alias("df")).where("df <> 0")
        write("sums", rows.withColumn("bucket", self._bucket("term")).repartition("bucket"), "term")
        count = lambda on: F.count(F.when(on, 1))
        rows = self._table("forward", FORWARD, [{"name": name, "forward": True}])
        told = rows.agg(count(F.col("sign") > 0).alias("added"), count(F.col("sign") < 0).alias("deleted"), F.coalesce(F.sum(F.col("sign") * F.col("n_words")), F.lit(0)).alias("words")).first()
        done = {"added": told.added, "deleted": told.deleted}
        note = {"number": number, "name": name, "docs": told.added - told.deleted, "words": told.words, "deleted": told.deleted}
        nothing = not told.added and not told.deleted
        if nothing or not self.notes.put(f"segments/{number:012d}", note | {k: k in made for k in ("forward", "sums", "blocks")}):
            for kind in made:
                self.notes.remove(f"{kind}/segment={name}")
            if not nothing:
                raise RuntimeError(f"another writer has changed {self.path}; nothing was written")
        return done

    def search(self, queries: DataFrame, k: int = 5, k1: float = retrieve.K1, b: float = retrieve.B, first: int = FIRST) -> DataFrame:
        """query_id, rank, id, score as retrieve.bm25 gives them on all chunks."""
        return retrieve.ranked(self.candidates(queries, k, k1, b, first).found, k)

    def candidates(self, queries: DataFrame, k: int, k1: float = retrieve.K1, b: float = retrieve.B, first: int = FIRST) -> Candidates:
        """What a search looks into: the blocks with the greatest bounds of a query are scored first, which gives a k-th
        score to beat; of the other blocks those whose bound doesn't reach it go."""
        segments = self._segments()
        n_docs, words = sum(s["docs"] for s in segments), sum(s["words"] for s in segments)
        mean = words / n_docs if words else 1.0
        asked = stage(retrieve.query_terms(queries), "asked")
        terms = asked.select("term").distinct()
        named = [r.term for r in terms.limit(LISTED + 1).collect()]
        buckets = [r[0] for r in terms.select(self._bucket("term")).distinct().collect()]
        only = F.col("term").isin(named) if len(named) <= LISTED else F.lit(True)
        sums = self._table("sums", SUMS, segments, buckets).where(only).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        rated = stage(asked.join(sums.withColumn("idf", index.idf(F.col("df"), n_docs)), "term").drop("df"), "rated")
        blocks = self._table("blocks", POSTED, segments, buckets).where(only)
        most = part(F.col("idf"), F.col("max_tf"), F.col("min_words"), mean, k1, b)
        key, place = ["query_id", "segment", "block"], ["segment", "block"]
        heads = blocks.select("term", *place, "max_tf", "min_words", "n").join(bounded(rated), "term")
        bounds = stage(heads.groupBy(*key).agg(F.sum(most).alias("bound"), F.sum("n").alias("n")), "bounds")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), *place))
        opening = settled(bounds.withColumn("r", rank).where(F.col("r") <= first).select(*key), "opening")
        removed = [s for s in segments if s["deleted"]]
        gone = self._members([]).select(*place, F.lit(None).cast("array<tinyint>").alias("gone"))
        if removed:  # later than the segment
            until = self._table("forward", FORWARD, removed).where("sign < 0").groupBy("id", "source").agg(F.max("segment").alias("segment"))
            gone = settled(self._places(segments, stage(until, "until"), lambda block, chunk: block < chunk), "gone")
        members = self._members(segments).join(gone, place, "left")

        def scored(pairs: DataFrame, own: retrieve.Asked) -> DataFrame:
            """The best hits among the chunks of blocks for all queries of a pass."""
            known = bounded(self.spark.createDataFrame(list(zip(own.vocabulary, range(len(own.vocabulary)), strict=True)), "term string, t int"), retrieve.PASS_WORDS)
            idf = np.zeros(len(own.vocabulary))
            for r in rated.select("term", "idf").distinct().join(known, "term").select("t", "idf").toLocalIterator():
                idf[r.t] = r.idf
            wanted = settled(pairs.select(*place).distinct(), "wanted")
            words = blocks.join(known, "term").join(wanted, place, "left_semi").groupBy(*place).agg(F.collect_list(F.struct("t", "slots", "tfs")).alias("words"))
            rows = chunk_rows(members.join(wanted, place, "left_semi").join(words, place))
            return retrieve.best_hits(rows, own, queries.schema["query_id"].dataType, k, lambda t, tf, n_words: part(idf[t], tf, n_words, mean, k1, b), retrieve.DIGITS)

        def among(pairs: DataFrame, own: retrieve.Asked) -> DataFrame:
            return pairs.where(F.col("query_id").between(F.lit(own.ids[0]), F.lit(own.ids[-1])))

        none = self.spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {self.id_type}, score double")
        union = lambda parts: reduce(DataFrame.unionByName, parts, none)
        passes = lambda: retrieve.passes(queries, k) if segments and k > 0 else ()
        opened = stage(union(scored(among(opening, own), own) for own in passes()), "opened")
        least = retrieve.ranked(opened, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        rest = bounds.join(opening, key, "left_anti").join(bounded(least), "query_id", "left")
        rest = stage(rest.where(F.col("least").isNull() | (F.col("bound") + 10.0**-retrieve.DIGITS >= F.col("least"))).select(*key), "rest")
        # blocks that a pass has opened were scored for all its queries
        more = (scored(among(rest, own).join(among(opening, own).select(*place).distinct(), place, "left_anti"), own) for own in passes())
        return Candidates(bounds, opening, rest, union([opened, *more]))
