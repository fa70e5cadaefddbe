"""Documents from files: text and Markdown by expressions, others by parsers in Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

Parser = Callable[[str, bytes], Iterator[tuple[int, str]]]
TEXT = (".md", ".txt")


def parse_pdf(path: str, data: bytes) -> Iterator[tuple[int, str]]:
    """Markdown of each page, by libraries that may be absent; a page without number gets its place."""
    import pymupdf
    import pymupdf4llm

    for k, page in enumerate(pymupdf4llm.to_markdown(pymupdf.open(stream=data, filetype="pdf"), page_chunks=True), 1):
        yield page.get("metadata", {}).get("page", k), page["text"]


PARSERS: dict[str, Parser] = {".pdf": parse_pdf}


def suffixes(parsers: dict[str, Parser] | None = None) -> list[str]:
    return sorted({*TEXT, *(PARSERS if parsers is None else parsers)})


def check_suffix(path: str, parsers: dict[str, Parser] | None = None) -> None:
    known = suffixes(parsers)
    name = path.rsplit("/", 1)[-1].lower()
    if "." in name and not any(name.endswith(s) for s in known) and "*" not in name:
        raise ValueError(f"no parser for {path}; there are {', '.join(known)}")


def scan(spark: SparkSession, path: str, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """Pages of a file or of all files below a folder: doc (the whole path), source (the name), page, text.

    Suffixes count in lower case; a single file of another suffix is an error, in a folder it is skipped. Bytes that
    aren't UTF-8 are left out. Parsers replace the given ones, and get a file of theirs as a whole."""
    check_suffix(path, parsers)
    own = PARSERS if parsers is None else parsers
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    files = files.withColumn("suffix", suffix)
    name = F.element_at(F.split(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), "/"), -1)
    plain = files.where(F.col("suffix").isin(*(s for s in TEXT if s not in own)))
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit(""))
    pages = plain.select(F.col("path").alias("doc"), name.alias("source"), F.lit(1).alias("page"), text.alias("text"))
    if own:

        def run(batches):
            for part in batches:
                for doc, source, kind, content in zip(part["doc"], part["source"], part["suffix"], part["content"], strict=True):
                    rows = [(doc, source, int(n), t) for n, t in own[kind](doc, content)]
                    yield pd.DataFrame(rows, columns=["doc", "source", "page", "text"])

        parsed = files.where(F.col("suffix").isin(*own)).select(F.col("path").alias("doc"), name.alias("source"), "suffix", "content")
        pages = pages.unionByName(parsed.mapInPandas(run, schemas.PAGES))
    return pages


def inline(spark: SparkSession, text: str, source: str = "user_input") -> DataFrame:
    return spark.createDataFrame([(source, source, 1, text)], schemas.PAGES)
