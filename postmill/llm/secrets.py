"""Secrets in whole texts: fixed patterns, and values that would be hard to guess.

The patterns find assigned values, access keys and long hexadecimal strings. Beyond them, a
value in a credential context (a word such as pwd or passphrase, then a separator) is judged
by the cost to guess it: over all ways to cut it into dictionary words, dates, repeats,
keyboard walks and brute-force characters, dynamic programming finds the fewest guesses. A
value that takes GUESSES or more is a secret too. In prose ("the password is ...") it must also
be of two classes of characters, as any long word may follow there. Dictionary words are the
common passwords' words, then the words of the public 50k vocabulary in its order, which goes
by frequency. A quoted value with blanks is judged whole, as a passphrase, if none of its words
is as common as prose needs (COMMON); else, as without quotes, the value ends at a blank. Each
text is read on its own, so nothing is shuffled.
"""

from __future__ import annotations

import base64
import functools
import math
import re

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The base patterns and their least lengths
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
VALUE_LENGTH = 8
KINDS = ("assign", "access", "hex", "guess")

CONTEXT = re.compile(
    r"""(?i:pass(?:word|wd|phrase|code|key)?|pwd|secret|token|api[_ -]?key|access[_ -]?key|secret[_ -]?key|private[_ -]?key|client[_ -]?secret|auth(?:orization|[_ -]?token)?|bearer|credentials?|login|pin)"""
    r"""["']?(?:\s*+(?:=>|:=|[:=])\s*+(?:(?i:bearer|basic)\s)?|\s++(?i:bearer|basic|(?P<prose>is|was))\s++)["'`]?(?P<value>[^\s"'`<>]+)"""
)
#: What may stand between a context word and its value, however many blanks; and the most that a context has besides blanks.
BETWEEN = re.compile(r"""["']?\s*+(?:=>|:=|[:=])\s*+""")
REACH = 64
QUOTES = "\"'`"
QUOTED = re.compile(r"""[^"'`<>\n]++""")
HINTS = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "credential", "login", "pin")
GUESSES = 9.0

WORDS = """
the and for you with this that from have your not are was all new one can has but our out use any day get her him his how man
now old see two way who boy did its let put say she too password pass word admin root user login test guest welcome master
secret token key access monkey dragon letmein football baseball sunshine princess shadow superman michael love hello freedom
whatever qazwsx trustno ninja mustang jordan hunter buster soccer harley batman andrew tiger charlie robert thomas hockey
ranger daniel starwars george computer michelle jessica pepper summer winter spring autumn changeme default example sample
temp demo server system database production staging service account mail home blue green black white silver gold orange
""".split()
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
UNLEET = str.maketrans("4@301!|$57+", "aaeoiiisstt"[:11])
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01]))?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?\d\d")


def _near() -> dict[str, set[str]]:
    """Keys next to each other, and the letters and digits in order."""
    near: dict[str, set[str]] = {}
    for y, row in enumerate(ROWS):
        for x, key in enumerate(row):
            near[key] = {r[i] for j, r in enumerate(ROWS) if abs(j - y) <= 1 for i in (x - 1, x, x + 1) if 0 <= i < len(r)} - {key}
    for order in ("abcdefghijklmnopqrstuvwxyz", "0123456789"):
        for a, b in zip(order, order[1:]):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    return near


NEAR = _near()
#: The words of common passwords come first in the dictionary
RANKS = {w: i + 1 for i, w in enumerate(dict.fromkeys(WORDS))}
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Words of the vocabulary that rank up to here are the stuff of prose and make no passphrase.
COMMON = 1_000
LONGEST = 20


@functools.cache
def dictionary(vocabulary: str = VOCABULARY) -> tuple[dict[str, int], frozenset[str]]:
    """(rank of each word from 1, the words that no passphrase has), read once per worker."""
    with open(public_tokenizers.path(vocabulary), "rb") as lines:
        tokens = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
    spaced = [t[1:].decode().lower() for _, t in tokens if t[:1] == b" " and t[1:].isalpha() and t.isascii() and 3 <= len(t) - 1 <= LONGEST]
    spaced = list(dict.fromkeys(spaced))
    return {w: i + 1 for i, w in enumerate(dict.fromkeys([*RANKS, *spaced]))}, frozenset(spaced[:COMMON])


def brute(char: str) -> float:
    """log10 of the characters of its class."""
    return 1.0 if char.isdigit() else math.log10(26) if char.isascii() and char.isalpha() else math.log10(33) if char.isascii() else 3.0


def guess_cost(value: str, ranks: dict[str, int] | None = None) -> tuple[float, list[tuple[str, int, int]]]:
    """(log10 of the fewest guesses, the cut (kind, start, end) that has it), in time linear in the value.

    A span costs the guesses of its kind; each change of kind costs a factor of two.
    """
    n, lower = len(value), value.lower()
    plain = lower.translate(UNLEET)
    longest = LONGEST if ranks is None else max(map(len, ranks), default=0)
    ranks = dictionary()[0] if ranks is None else ranks
    best, via = [0.0] + [math.inf] * n, [None] * (n + 1)
    glue = math.log10(2)

    def offer(kind: str, i: int, j: int, cost: float) -> None:
        # a brute-force character that follows another is of the same span
        total = best[i] + cost + (0.0 if kind == "brute" and via[i] and via[i][0] == "brute" else glue)
        if total < best[j] - 1e-12:
            best[j], via[j] = total, (kind, i)

    repeat = walk = 0
    for j in range(1, n + 1):
        offer("brute", j - 1, j, brute(value[j - 1]))
        if j > 1:
            repeat = repeat if value[j - 1] == value[j - 2] else j - 1
            walk = walk if lower[j - 1] in NEAR.get(lower[j - 2], ()) else j - 1
        # of runs that end here the whole one serves best, and what a walk leaves to another span is a walk too
        if j - repeat >= 3:
            offer("repeat", repeat, j, brute(value[j - 1]) + math.log10(j - repeat))
        for start in {walk, max(walk, j - 8), max(walk, j - 4)}:
            if j - start >= 3:
                offer("walk", start, j, math.log10(len(NEAR) * 3.0) + (j - start) * math.log10(1.6))
        for i in range(max(0, j - longest), j - 2):
            rank, leet = ranks.get(lower[i:j]), False
            if rank is None and plain[i:j] != lower[i:j]:
                rank, leet = ranks.get(plain[i:j]), True
            if rank:
                offer("word", i, j, math.log10(rank) + glue * (2 * leet + (not value[i:j].islower()) * (1 if value[i:j].istitle() or value[i:j].isupper() else 2)))
        for length in (4, 6, 8, 10):
            if length <= j and DATE.fullmatch(value, j - length, j):
                offer("date", j - length, j, math.log10(120) if length == 4 else math.log10(365 * 120))
    cut, j = [], n
    while j:
        kind, i = via[j]
        if cut and kind == "brute" == cut[-1][0]:
            cut[-1] = (kind, i, cut[-1][2])
        else:
            cut.append((kind, i, j))
        j = i
    return best[n], cut[::-1]


def mixed(value: str) -> bool:
    """Characters of two classes at least: what is asked of values in prose."""
    return (any(c.isdigit() for c in value) + any(c.islower() for c in value) + any(c.isupper() for c in value[1:]) + any(not c.isalnum() for c in value[:-1])) > 1


def named(text: str, start: int, end: int) -> bool:
    """Whether what stands there ends in the name of a value that follows."""
    blanks = BETWEEN.match(text, end)
    m = CONTEXT.search(text, start, (blanks.end() if blanks else end) + REACH)
    return bool(m) and m.start() < end < m.start("value") and any(c in ":=" for c in text[end : m.start("value")])


def passphrase_end(text: str, m: re.Match) -> int | None:
    """Where the quoted words end that the context m opens, if they can be a passphrase."""
    start = m.start("value")
    quote = text[start - 1]
    inner = QUOTED.match(text, start) if quote in QUOTES and m[0].lower().startswith(("pass", "secret")) else None
    if not inner or text[inner.end() : inner.end() + 1] != quote:
        return None
    words = inner[0].lower().split(" ")
    common = dictionary()[1]
    return inner.end() if len(words) > 1 and all(len(w) > 2 and w not in common for w in words) else None


def secret_spans(text: str | None, guesses: float = GUESSES) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as in KINDS; code points, end exclusive."""
    text = text or ""
    folded = text.lower()
    out: list[tuple[int, int, str]] = []
    if any(w in folded for w in ("passw", "secret", "token", "api")):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= VALUE_LENGTH]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    if any(w in folded for w in HINTS):
        at = 0
        while m := CONTEXT.search(text, at):
            start, end = m.start("value"), passphrase_end(text, m)
            value = text[start:end] if end else m["value"].rstrip(".,;:!?)]}")
            end = start + len(value)
            taken = [b for a, b, _ in out if a < end and start < b]
            if not taken and len(value) >= VALUE_LENGTH and (mixed(value) or not m["prose"]) and not named(text, start, end) and guess_cost(value)[0] >= guesses:
                out.append((start, end, "guess"))
                taken = [end]
            # the next context may begin in this value, and in what was found only where its own value lies behind it
            at = max([start, *(b - REACH for b in taken)])
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))


def scan_secrets(docs: DataFrame, guesses: float = GUESSES) -> DataFrame:
    """doc_id and spans (array of start, end, kind) of every row of docs.

    Null and empty texts have none. Repeated rows are scanned each; rows without an id keep
    a null id; an empty table gives no rows; other columns are not read.
    """

    def scan(batches):
        for batch in batches:
            spans = [[dict(zip(("start", "end", "kind"), s)) for s in secret_spans(t.as_py(), guesses)] for t in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), pa.array(spans, SPANS)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, "doc_id long, spans array<struct<start:int,end:int,kind:string>>")


def redact(text: str | None, mark: str = "[SECRET]", guesses: float = GUESSES) -> str | None:
    """The text with a mark in the place of each secret; overlapping ones share it."""
    spans = secret_spans(text, guesses)
    if not spans:
        return text
    out, at, end = [], 0, 0
    for a, b, _ in spans:
        if a >= end:
            out += [text[end:a], mark]
        end = max(end, b)
    return "".join([*out, text[end:]])


def redact_documents(docs: DataFrame, guesses: float = GUESSES) -> DataFrame:
    """The rows of docs, all columns, with the secrets of text marked and n_chars, if there, counted anew."""
    names = docs.columns
    docs = docs.withColumn("n_chars", F.col("n_chars").cast("long")) if "n_chars" in names else docs

    def clean(batches):
        for batch in batches:
            texts = [redact(t.as_py(), guesses=guesses) for t in batch.column("text")]
            columns = {c: batch.column(i) for i, c in enumerate(names)} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield pa.record_batch([columns[c] for c in names], names)

    return docs.mapInArrow(clean, docs.schema)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, spans and a digest of the base spans of every document."""
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    number = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(number, KINDS), F.sha2(told(F.filter("spans", lambda s: s.kind != "guess")), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"),
    )
