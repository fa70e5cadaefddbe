"""Secrets by dictionary-primed zstandard novelty (operator 10).

Base rules give spans of the kinds assign, access and hex. The method adds spans of kind novel: strings next to a
word of sensitive context whose marginal size is high. A candidate's marginal size is what it adds, in bytes,
when it is compressed after its surroundings with a raw-content dictionary of identifiers and code: strings made
of names, words or repetitions cost little, random ones nearly their entropy. Long words of prose cost as much as
random letters, so a string of letters alone must also have pairs of letters that words don't have. Base spans are always reported, with
their novelty. Spans are in code points, the end exclusive."""

from __future__ import annotations

import hashlib
import re

import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "novel")
BASE = KINDS[:3]
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so this equals taking all runs and dropping short ones

#: Words of sensitive context, and the candidates that begin in the characters after one.
CONTEXT = re.compile(r"(?:credential|passphrase|pass_?code|private[_ -]?key|client[_ -]?secret|secret|access[_ -]?key|auth(?:orization)?|bearer|session[_ -]?id|pwd|passwd|password|api[_ -]?key|token|signature|connection[_ -]?string)[a-z_]*", re.IGNORECASE | re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.~-]{12,}")
RUN = re.compile(r"[A-Za-z0-9+/_=.~-]+")
#: A line of one run after a break, also an escaped one, and the end of a key.
NEXT_LINE = re.compile(r"(?:[ \t]*+\r?\n[ \t>]*+|(?:\\r)?\\n)(?!-----)([A-Za-z0-9+/_=.~-]++)(?=[ \t]*+(?:\r?\n|\Z)|[\\\"'])")
END = re.compile(r"(?:\s|\\[rn]|[\"'])*+-----END")
REACH = 80  # characters after the word of context
MIN_CHARS = 12
WRAPPED = 40  # characters from which on lines of one length belong together
AROUND = 200  # characters on either side that prime the compressor
MIN_NOVELTY = 0.55  # marginal bytes a byte
MIN_MARGINAL = 9  # bytes
WORD_BITS = -2.0  # how much likelier, in bits, letters are in words than at random, from which on they count as words

#: What primes the compressor besides the surroundings: names and idioms of program text.
IDENTIFIERS = """
password passwd secret token api_key apikey access_key secret_key client_id client_secret authorization bearer username user_id
example placeholder changeme your_token_here your-api-key xxxxxxxxxxxxxxxx 0000000000000000 1234567890 abcdefghijklmnopqrstuvwxyz
ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789abcdef import from return function class public private static void string integer boolean
const let var def self this null None true false undefined export default require module config settings environment process.env
getenv os.environ System.getProperty http https www localhost application/json Content-Type charset=utf-8 utf-8 timestamp version
name value key index length size count list array object map dictionary result response request header body message error status
create update delete select insert where order group limit offset connect connection database server client session cookie path
file directory input output buffer stream reader writer parser handler manager factory service controller repository component
""".strip()

#: A row for each first letter, a column for each second one: log2 of the pair's frequency in words over that in random
#: letters, in half bits from -6 (a) to 3.5 (t). From English program text and messages in twelve European languages.
PAIRS = """
klmnfhlimimpnqfldpnpkkigji
rjjgqfghqkephhphbomipdfckf
qdkhpfeqohnmhgrgcmkolddbhj
qhhkshhiqhhkhkqibmminhgfii
linnkklhkhlomqhkgqpohjhlhi
ofijpoheseenhhqidolmncfdjd
qigirfllofhljnojbonkofhcjf
refjrfchqghljjqebmjnnfgajc
nknmnkmfhilnmrnkfmooglehgk
rghkrhgfogkljkpjdinkohgdei
rgigqghkpclmhkqialnnogjajc
qhhlrhihqgiojjphaflmmhecle
rnghrffepcgkljpoagkinfechd
pgmppkphpgkihknhcfnqliebkh
ilmnijkikhlonqkmdqonmmlffj
qfjiqhhjobhogiqmeqlnmffcja
mhhiiggglggjgijhilijtgjggg
qiklrhkgqgkjlkpiclnnmigbki
ogngqhgmpdmlihnmehornhgbkl
qfjhrhdmqehkiipiaommnggclf
nmllnjlgmklooqkmcpoojigghi
sgggsefeqdghgjpgbkiglfeelg
sgjkqhgkqdgjgmoicmmhjeihmf
okokplhjpeiklglqejlrjggjlf
qkmkojjjnjlmonnpckoolhkeji
riijreiipgjkjmoicijlmijbmk
""".split()
BITS = {chr(97 + i) + chr(97 + k): (ord(c) - 109) / 2 for i, row in enumerate(PAIRS) for k, c in enumerate(row)}
#: Numbers that aren't random: addresses, and dates with or without time.
NUMBER = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}|(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])(?:[-/._]?[0-5]\d){0,3}", re.ASCII)


def compressed(data: bytes, primer: bytes) -> int:
    how = zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False)
    return len(how.compress(data))


def novelty(text: str, start: int, end: int) -> tuple[int, float]:
    """Marginal bytes of text[start:end] against its surroundings and the identifiers, and the same a byte.

    Strings of the surroundings that might be secrets themselves are left out: one that stands there twice is no less
    a secret."""
    around = text[max(0, start - AROUND) : start] + "\n" + text[end : end + AROUND]
    around = CANDIDATE.sub(lambda m: m[0] if wordlike(m[0]) else " ", around)
    primer = (IDENTIFIERS + "\n" + around).encode("utf-8", "replace")
    body = text[start:end].encode("utf-8", "replace")
    marginal = max(0, compressed(body, primer) - compressed(b"", primer))
    return marginal, marginal / max(1, len(body))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by start, then in the order of the kinds. Failing matches are consumed and dropped."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def mixed(word: str) -> bool:
    """Whether a string has digits beside letters, or capitals inside: names and words of prose have not."""
    return any(c.isdigit() for c in word) and any(c.isalpha() for c in word) or bool(re.search("[a-z][A-Z].*[a-z][A-Z]", word))


def wordlike(word: str) -> bool:
    """Whether a string may be made of names, words, usual numbers or signs alone, so that its novelty says nothing."""
    if mixed(word):
        return False
    if any(map(str.isalpha, word)):
        low = word.lower()
        return sum(BITS.get(low[i : i + 2], 0.0) for i in range(len(low) - 1)) >= WORD_BITS
    digits = word.strip("+/_=.~-")
    return not digits or bool(NUMBER.fullmatch(digits))


def find(text: str | None, min_novelty: float = MIN_NOVELTY) -> list[tuple[str, int, int, int, float]]:
    """All spans (kind, start, end, marginal bytes, novelty) by start, then kind.

    A candidate that is reported goes on over following lines of one run each: those that are reported by themselves,
    those of the same length where it is long, and the shorter last one of such lines or before an end mark."""
    text = text or ""
    base = base_spans(text)
    out = [(*s, *novelty(text, s[1], s[2])) for s in base]
    known = sorted((a, b) for _, a, b in base)
    past = k = 0  # behind the last candidate; the first base span that may reach the next one

    def judge(start, end, sure=False):
        """Whether the candidate is reported or a base span; reports it. sure: without measuring it."""
        nonlocal past, k
        past = end
        while k < len(known) and known[k][1] <= start:
            k += 1
        if any(a < end and start < b for a, b in known[k : k + 2 * len(KINDS)]):
            return True
        if not sure and (end - start < MIN_CHARS or wordlike(text[start:end])):
            return False
        marginal, rate = novelty(text, start, end)
        if not sure and (rate < min_novelty or marginal < MIN_MARGINAL):
            return False
        out.append(("novel", start, end, marginal, rate))
        return True

    for context in CONTEXT.finditer(text):
        for m in RUN.finditer(text, context.end(), min(len(text), context.end() + REACH)):
            if m.start() < past:
                continue
            start, end = m.start(), RUN.match(text, m.start()).end()  # one that goes on beyond the reach is taken whole
            start += text[start - 1] == "\\" and text[start] in "nrt"  # the letter of an escaped break
            if end - start < MIN_CHARS or not judge(start, end):
                continue
            wrapped = last = False
            while not last and (line := NEXT_LINE.match(text, end)):
                width, size = end - start, len(line[1])
                same = size == width >= WRAPPED
                last = size < width >= WRAPPED and bool(wrapped and not wordlike(line[1]) or END.match(text, line.end()))
                if not judge(*line.span(1), sure=same or last):
                    break
                wrapped = wrapped or same
                start, end = line.span(1)
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def find_secrets(docs: DataFrame, min_novelty: float = MIN_NOVELTY) -> DataFrame:
    """docs with secrets, an array of (kind, start, end, marginal, novelty); null and empty texts have none.

    It replaces a column secrets."""

    def make():
        names = ("kind", "start", "end", "marginal", "novelty")
        return lambda texts: [[[dict(zip(names, s, strict=True)) for s in find(t, min_novelty)] for t in texts]]

    return common.map_columns(docs, ["text"], make, "secrets array<struct<kind:string,start:int,end:int,marginal:int,novelty:double>>")


def op10_zstd_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, numbers of the base kinds, a digest of the base spans, all spans, the highest novelty."""
    docs = find_secrets(common.load(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    part = lambda kinds: F.filter("secrets", lambda s: s["kind"].isin(*kinds))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(part([k])).cast("long").alias(f"n_{k}") for k in BASE]
    novel = F.array_max(F.transform("secrets", lambda s: s["novelty"])).alias("max_novelty")
    return docs.select("doc_id", *counts, F.sha2(text(part(BASE)), 256).alias("base_sha256"), text(F.col("secrets")).alias("spans"), novel)


def digest(spans: list[tuple]) -> str:
    return hashlib.sha256(",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans).encode()).hexdigest()
