"""Token counts as rollups that deltas maintain (operator 4).

A ledger holds, for each committed batch, the signed sums of its documents and tokens by source, language and
tokenizer version. Inserts add, deletes subtract, revised counts do both, maybe under another version. Totals are kept
by compactions and never need the documents again: what is read is the latest totals and the batches since. A batch
counts from the moment that a file of its id is there, which only one driver can put there; a task or driver that fails
leaves nothing that counts."""

from __future__ import annotations

import base64
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.notes import Notes
from . import common

TOKENIZERS = "/opt/tokenizers"
FIRST, SECOND = "byte_bpe_50k", "byte_bpe_multi_50k"
#: How byte-level BPE cuts text before merging; part of the public vocabulary's definition.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEYS = ("source", "lang", "tokenizer")
SUMS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
#: Runs of white space that are cut out before the pattern, which steps back once for each of their characters.
LONG_GAP = re.compile(r"[\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{100,}")


def encoder(name: str, folder: str = TOKENIZERS):
    """A byte-level BPE by the ranks in folder; strings of special tokens are ordinary text."""
    import tiktoken

    with open(f"{folder}/{name}.tiktoken", "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def n_tokens(own, text: str | None) -> int:
    """Tokens of a text. The pattern makes a run of white space one piece but for its last character, which may lead the
    next word, or as a whole at the end of the text; long runs are cut there."""
    text, total, at = text or "", 0, 0
    for m in LONG_GAP.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        total += len(own.encode_ordinary(text[at : m.start()])) + len(own._encode_single_piece(text[m.start() : end]))
        at = end
    return total + len(own.encode_ordinary(text[at:]))


def count_tokens(docs: DataFrame, names: dict[str, str], folder: str = TOKENIZERS) -> DataFrame:
    """docs with a column for each tokenizer: names maps columns to vocabularies. Null and empty texts count 0.

    A boolean column do_<column> of docs, if there is one, says which rows need the count; others get null.
    The vocabularies must be in folder on every executor."""
    asked = [f"do_{c}" for c in names if f"do_{c}" in docs.columns]

    def make():
        encoders = {c: encoder(n, folder) for c, n in names.items()}

        def step(texts, *flags):
            wanted = dict(zip(asked, flags, strict=True))
            out = []
            for column, e in encoders.items():
                on = wanted.get(f"do_{column}", [True] * len(texts))
                out.append([n_tokens(e, t) if o else None for t, o in zip(texts, on, strict=True)])
            return out

        return step

    return common.map_columns(docs, ["text", *asked], make, ", ".join(f"{c} long" for c in names))


class Ledger:
    """Signed sums of batches in a folder that driver and executors share.

    data/ has the sums of batches and of compactions under names of their own. What counts is told by small files:
    batches/<id> names the data of a batch, totals/<number> those of a compaction and the batches that it holds. Of two
    drivers one can put such a file; data that no file names don't count."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.notes = Notes(spark, folder)

    def has(self, batch: str) -> bool:
        if not batch or not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"a batch id has letters, digits, - and _ only: {batch!r}")
        return self.notes.has(f"batches/{batch}")

    def _store(self, sums: DataFrame) -> str:
        name = uuid.uuid4().hex
        sums.write.parquet(f"{self.folder}/data/{name}")
        return name

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """changes (source, lang, tokenizer, sign, n_tokens): sign is 1 or -1, null tokens count 0. Sums are taken
        before the shuffle. False if the batch is there already; then changes don't count."""
        if self.has(batch):
            return False
        sums = changes.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.coalesce("n_tokens", F.lit(0))).cast("long").alias("n_tokens"))
        name = self._store(sums)
        if self.notes.put(f"batches/{batch}", {"data": name}):
            return True
        self.notes.remove(f"data/{name}")  # another driver was first
        return False

    def _current(self) -> tuple[dict, list[str]]:
        """What the latest compaction says, and the batches since."""
        told = self.notes.names("totals")
        latest = self.notes.read(f"totals/{told[-1]}") if told else {"data": None, "batches": [], "number": 0}
        return latest, [b for b in self.notes.names("batches") if b not in set(latest["batches"])]

    def _sums(self, latest: dict, batches: list[str]) -> DataFrame:
        names = [latest["data"]] * (latest["data"] is not None) + [self.notes.read(f"batches/{b}")["data"] for b in batches]
        if not names:
            return self.spark.createDataFrame([], SUMS)
        rows = self.spark.read.schema(SUMS).parquet(*(f"{self.folder}/data/{n}" for n in names))
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def compact(self) -> bool:
        """Adds the batches since the latest compaction to its totals, which are then read in their place. False if there
        are none, or another driver was first. Batches stay known under their ids."""
        latest, batches = self._current()
        if not batches:
            return False
        number, name = latest["number"] + 1, self._store(self._sums(latest, batches))
        if self.notes.put(f"totals/{number:012d}", {"data": name, "batches": sorted([*latest["batches"], *batches]), "number": number}):
            return True
        self.notes.remove(f"data/{name}")
        return False

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens: the latest compaction and the batches since; groups without
        documents are left out."""
        return self._sums(*self._current()).where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))


def change(rows: DataFrame, sign: int, tokenizer: str, n_tokens: Column) -> DataFrame:
    return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(sign).alias("sign"), n_tokens.alias("n_tokens"))


def op4_delta_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted under the first version; a tenth is deleted, three tenths are counted anew under
    the second version; the batch of deletes is sent twice."""
    part = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)), F.lit(9))
    docs = common.load(spark, sf_dir, "documents").select("text", "source", "lang", part.alias("part"), part.between(1, 3).alias("do_n_second"))
    rows = common.stage(count_tokens(docs, {"n_first": FIRST, "n_second": SECOND}).drop("text", "do_n_second"), "counts")
    ledger = Ledger(spark, f"{common.shared_dir(spark)}/findery/ledger-{uuid.uuid4().hex}")
    revised = rows.where(F.col("part").between(1, 3))
    ledger.commit("insert", change(rows, 1, f"{FIRST}@1", F.col("n_first")))
    for _ in range(2):
        ledger.commit("delete", change(rows.where("part = 0"), -1, f"{FIRST}@1", F.col("n_first")))
    ledger.compact()
    ledger.commit("revise", change(revised, -1, f"{FIRST}@1", F.col("n_first")).unionByName(change(revised, 1, f"{SECOND}@2", F.col("n_second"))))
    return ledger.totals()
