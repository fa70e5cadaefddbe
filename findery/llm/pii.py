"""Personal data by anchor expansion (operator 1).

An Aho-Corasick automaton finds anchors in the whole text: at-signs, plus signs, digits, schemes and identifier
cues. A deterministic parser for each kind of anchor expands it to the left and right and validates what it
finds. Spans are in code points, the end exclusive. Kinds:

email, ip, card, phone   the base kinds; for each, matches are leftmost and don't overlap, a match that fails
                         its check is dropped and not tried again from within
iban                     two letters, two digits, 11 to 30 letters or digits, single blanks allowed; mod 97 is 1
account                  after a cue that is a word of its own (account, acct, konto, compte, cuenta, ssn, passport ...): 6 to 20 digits with
                         single blanks or hyphens, not part of another span
link                     a scheme with a user name before an at-sign, or mailto: or tel: with what follows it
"""

from __future__ import annotations

import bisect
import hashlib
import re

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone", "iban", "account", "link")
BASE = KINDS[:4]
DIGITS = frozenset("0123456789")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
ALNUM = LABEL - {"-"}
PHONE = frozenset(" ().0123456789-")
CUES = ("account", "acct", "konto", "kontonummer", "bankkonto", "girokonto", "compte", "cuenta", "iban", "ssn", "social security", "passport", "steuernummer", "dni")
SCHEMES = ("://", "mailto:", "tel:")

_PATH = re.compile("[/?#]")
_LINK = re.compile(r"[^\s<>\"'\[\]{}|\\^`]*")
_AFTER_CUE = re.compile(r"[\x20\t]{0,3}(?:(?:number|no\.?|nr\.?|num\.?|id)[\x20\t]{0,3})?[:=#.]{0,2}[\x20\t]{0,3}([0-9](?:[\x20-]?[0-9])*)", re.IGNORECASE | re.ASCII)
_IBAN = re.compile(r"[\x20\t]{0,3}[:=#.]{0,2}[\x20\t]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})")


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for sign in ("@", "+", *DIGITS):
        found.add_word(sign, (sign, 1))
    for word in SCHEMES:
        found.add_word(word, ("scheme", len(word)))
    for word in CUES:
        for form in {word, word.title(), word.capitalize(), word.upper()}:
            found.add_word(form, ("cue", len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d)
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def parse_email(text: str, at: int, free: int) -> tuple[int, int] | None:
    """The address around the at-sign at this place, using nothing before free."""
    start, n = at, len(text)
    while start > free and text[start - 1] in LOCAL:
        start -= 1
    end = at + 1
    while end < n and text[end] in LABEL:
        end += 1
    if start == at or end == at + 1:
        return None
    labels = 0
    while end + 1 < n and text[end] == "." and text[end + 1] in LABEL:
        end += 2
        while end < n and text[end] in LABEL:
            end += 1
        labels += 1
    return (start, end) if labels else None


def digit_run(text: str, at: int) -> int:
    n = len(text)
    while at < n and text[at] in DIGITS:
        at += 1
    return at


def parse_ip(text: str, start: int) -> int:
    """End of four runs of digits with single dots between, of which the first begins here; 0 if there are fewer."""
    at = start
    for part in range(4):
        if part:
            if at >= len(text) or text[at] != ".":
                return 0
            at += 1
        end = digit_run(text, at)
        if end == at:
            return 0
        at = end
    return at


def is_octet(digits: str) -> bool:
    """Whether a run of digits of any length, leading zeros included, is at most 255."""
    short = digits.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def parse_card(text: str, start: int) -> int:
    """End of the chain of digits with at most one blank or hyphen between two, which begins here."""
    n, at = len(text), start + 1
    while at < n:
        if text[at] in DIGITS:
            at += 1
        elif text[at] in " -" and at + 1 < n and text[at + 1] in DIGITS:
            at += 2
        else:
            break
    return at


def parse_phone(text: str, plus: int) -> int:
    """End of a number after the plus sign: a digit, one or more of the signs of PHONE, and a digit; 0 if none."""
    n, at, last = len(text), plus + 2, 0
    if plus + 1 >= n or text[plus + 1] not in DIGITS:
        return 0
    while at < n and text[at] in PHONE:
        if text[at] in DIGITS:
            last = at
        at += 1
    return last + 1 if last >= plus + 3 else 0


def iban_ok(compact: str) -> bool:
    moved = compact[4:] + compact[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def find(text: str | None, anchors: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All spans of a text as (kind, start, end), in the order of KINDS, then by start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    free = dict.fromkeys(KINDS, 0)
    after_run = 0  # past the last run of digits that ip has looked at
    cues: list[int] = []
    links: list[tuple[int, int]] = []
    tail = trimmed = 0
    for last, (what, length) in anchors.iter(text or ""):
        if what in DIGITS:
            if last >= after_run:
                after_run = digit_run(text, last)
                if last >= free["ip"] and (end := parse_ip(text, last)):
                    free["ip"] = end
                    if all(map(is_octet, text[last:end].split("."))):
                        found["ip"].append((last, end))
            if last >= free["card"]:
                free["card"] = end = parse_card(text, last)
                digits = text[last:end].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append((last, end))
        elif what == "@":
            if span := parse_email(text, last, free["email"]):
                free["email"] = span[1]
                found["email"].append(span)
        elif what == "+":
            if last >= free["phone"] and (end := parse_phone(text, last)):
                free["phone"] = end
                if 9 <= sum(c in DIGITS for c in text[last:end]) <= 15:
                    found["phone"].append((last, end))
        elif what == "scheme":
            links.append((last - length + 1, last + 1))
        else:
            start = last + 1 - length
            if not start or not text[start - 1].isalnum():  # else the cue ends a longer word
                cues.append(last + 1)
    for start, end in links:
        if end > tail:
            tail = trimmed = _LINK.match(text, end).end()  # of schemes in one run of signs, the first has looked for its end
            while trimmed > end and text[trimmed - 1] in ".,;:!?)":
                trimmed -= 1
        _link(text, start, end, max(end, trimmed), found, free)
    taken = joined_up(s for kind in (*BASE, "link") for s in found[kind])
    for at in sorted(set(cues)):
        _account(text, at, found, free, taken)
    return [(kind, *span) for kind in KINDS for span in found[kind]]


def joined_up(spans) -> list[tuple[int, int]]:
    """Spans as disjoint ones, by start."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def _link(text: str, start: int, end: int, tail: int, found: dict, free: dict) -> None:
    if text.startswith("://", start):
        while start > free["link"] and text[start - 1] in ALNUM:
            start -= 1
        path = _PATH.search(text, end, tail)
        if text.find("@", end, path.start() if path else tail) < 0 or text[start] == ":":
            return
    elif tail == end or (start and text[start - 1] in ALNUM):
        return
    if start >= free["link"]:
        free["link"] = tail
        found["link"].append((start, tail))


def _account(text: str, at: int, found: dict, free: dict, taken: list[tuple[int, int]]) -> None:
    if at < len(text) and text[at] in ALNUM:
        return  # the cue goes on as a longer word
    if (m := _IBAN.match(text, at)) and m.start(1) >= free["iban"]:
        for end in range(m.end(), m.start(1) + 14, -1):  # the longest that checks
            compact = text[m.start(1) : end].replace(" ", "")
            if len(compact) >= 15 and text[end - 1] != " " and (end == len(text) or text[end] not in ALNUM) and iban_ok(compact):
                free["iban"] = free["account"] = end
                found["iban"].append((m.start(1), end))
                return
    if (m := _AFTER_CUE.match(text, at)) and 6 <= sum(c in DIGITS for c in m[1]) <= 20 and m.start(1) >= free["account"]:
        start, end = m.span(1)
        k = bisect.bisect_left(taken, (end,))  # of disjoint spans, only the last that starts before end may overlap
        if not k or taken[k - 1][1] <= start:
            free["account"] = end
            found["account"].append((start, end))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """docs with pii, an array of (kind, start, end); null and empty texts have none. It replaces a column pii."""

    def make():
        anchors = automaton()

        def step(texts):
            return [[[{"kind": k, "start": a, "end": b} for k, a, b in find(t, anchors)] for t in texts]]

        return step

    return common.map_columns(docs, ["text"], make, "pii array<struct<kind:string,start:int,end:int>>")


def mask_pii(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by its kind in angle brackets; of spans that overlap, the first
    start counts, then the longest. Null texts stay null, texts without spans are as they were."""

    def make():
        anchors = automaton()

        def masked(text):
            if text is None:
                return None
            out, at = [], 0
            for kind, start, end in sorted(find(text, anchors), key=lambda s: (s[1], -s[2], s[0])):
                if start >= at:
                    out += [text[at:start], f"<{kind}>"]
                    at = end
                elif end > at:
                    at = end  # the rest of a span that overlaps goes with the one before
            return "".join([*out, text[at:]])

        return lambda texts: [[masked(t) for t in texts]]

    order = docs.columns
    return common.map_columns(docs, ["text"], make, "text string").select(*order)


def op1_anchor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, numbers of the base kinds, a digest of the base spans and all spans as a string."""
    docs = find_pii(common.load(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    part = lambda kinds: F.filter("pii", lambda s: s["kind"].isin(*kinds))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(part([k])).cast("long").alias(f"n_{k}") for k in BASE]
    return docs.select("doc_id", *counts, F.sha2(text(part(BASE)), 256).alias("base_sha256"), text(F.col("pii")).alias("spans"))


def brute_base(text: str | None) -> list[tuple[str, int, int]]:
    """The base rules by regular expressions over the whole text, for tests."""
    text = text or ""
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(map(is_octet, m.split(".")))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub(r"[ -]", "", m)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, ok) in rules.items() for m in re.finditer(p, text) if ok(m[0])]


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
