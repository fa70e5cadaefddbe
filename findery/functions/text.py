"""Text expressions. Word, white space and line break classes are spelled out, since engines differ on \\w and \\s."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
BREAK = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029]"

# What comparison treats alike.
DASHES = "‐‑‒–—―−"
CURLY, STRAIGHT = "‘’“”", "''\"\""
MARKUP = "*_`"
# Signs around the text of a running header or footer.
EDGE = " *_#|-•\t"
#: The characters of SPACE, for functions that take a list.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def tokens(text: Column) -> Column:
    """Words of the lower-cased text, in order; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD}+)"), 1)


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def squeeze(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, f"{SPACE}+", " "), F.lit(" "))


def lines(text: Column) -> Column:
    """Lines without their breaks; a break at the end opens no line, an empty text has none."""
    parts = F.split(text, BREAK)
    last = F.element_at(parts, -1) == ""
    return F.when(last, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def count_words(text: Column) -> Column:
    """White-space words."""
    bare = strip(text)
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, f"{SPACE}+")))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKC")


def nfkc(text: Column) -> Column:
    """Compatibility composition. ASCII is invariant under it and is not sent to Python."""
    return F.coalesce(_nfkc(F.when(~is_ascii(text), text)), text)


def comparable(text: Column, ascii_only: bool = False) -> Column:
    """The form in which texts are compared: one kind of dash and quote, no emphasis, single blanks, lower case."""
    whole = text if ascii_only else nfkc(text)
    one = F.translate(whole, DASHES + CURLY + MARKUP, "-" * len(DASHES) + STRAIGHT)
    return F.lower(squeeze(one))


def line_key(line: Column) -> Column:
    """A line without digits and without the signs around it, lower-cased."""
    return F.lower(F.btrim(F.regexp_replace(line, r"\p{Nd}+", ""), F.lit(EDGE)))


def join_hyphens(text: Column) -> Column:
    return F.regexp_replace(text, f"({WORD})-\n({WORD})", "$1$2")


def sha1_prefix(*parts: Column, digits: int = 16) -> Column:
    joined = parts[0]
    for p in parts[1:]:
        joined = F.concat(joined, F.lit("|"), p)
    return F.substring(F.sha1(joined), 1, digits)


def slug(name: str) -> str:
    """Name of the table that holds the vectors of a model."""
    import re

    return "chunks__" + re.sub("[^a-z0-9]+", "-", name.lower()).strip("-")
