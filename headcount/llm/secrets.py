"""Secrets, and weak candidates that only their company gives away.

Patterns find what is a secret by itself: assignments to a telling name, access
identifiers and long hexadecimal runs. Everything else that may be part of a credential is
weak: a user name, a random-looking word, a short assignment or an address of a service
means nothing alone. Parts are linked by an interval join: within a scope (lines without a
blank line or a section heading between them) parts that start within `REACH` characters
of each other stand together, and a weak part is reported only if the parts beside it make
it a credential:

* a secret beside a strong identifier, or beside a weak identifier and an endpoint;
* an identifier beside a strong secret, or beside a weak secret and an endpoint;
* an endpoint beside an identifier and a secret.

Python sees one text at a time. The join is on cells of `REACH` characters, so a part
meets those of three cells, however many its text or scope holds; parts of equal texts
are linked once.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headcount.session import Scratch

#: Kinds in the order that breaks ties of equal starts; weak parts come last.
KINDS = ("assign", "access", "hex")
PARTS = ("identifier", "secret", "endpoint")
IDENTIFIER, SECRET, ENDPOINT = range(3)
#: Whether a base kind is an identifier or a secret.
ROLE = (SECRET, IDENTIFIER, SECRET)

#: Characters between the starts of parts that stand together.
REACH = 300
#: Bits per character, and classes of characters, of a word that looks random.
RANDOM, CLASSES = 3.0, 2
#: Characters of text whose results leave a task together.
SLICE = 1_000_000
#: Rows that may share one text's parts before they are dealt out.
SALTS = 16

ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A
)
#: One of these is in lower case in every text that ASSIGN matches.
TOLD = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f](?<![0-9a-f].)[0-9a-f]{23,}", re.S)

#: What follows a name, and the names by part; names end where the assignment begins.
VALUE = re.compile(r"[:=]\x20*+[\"']?([^\s\"',;<>&:=/][^\s\"',;<>&]{1,255})")
NAMES = re.compile(
    r"(?<![A-Za-z0-9])(?:"
    r"(user_?name|user_?id|user|login|account_?id|account|client_?id|access_?key_?id|access_?key)"
    r"|(pass_?phrase|password|passwd|pass|pwd|pin|secret_?key|client_?secret|secret|private_?key"
    r"|api_?key|auth_?key|key|credentials?|token)"
    r"|(end_?point|host_?name|host|server|base_?url|url|uri|region|bucket)"
    r")[\"']?\x20*\Z",
    re.I | re.A,
)
#: Characters before an assignment where its name is looked for.
NAME = 40
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*\Z")
REST = re.compile(r"(?:([^\s:/@\"'<>]{1,256}):([^\s/@\"'<>]{1,256})@)?([A-Za-z0-9_.-]{1,253}(?::[0-9]{1,5})?)")
IP = re.compile(r"[0-9](?<![0-9.].)[0-9]{0,2}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?(?![0-9.])", re.S)
WORD = re.compile(r"[A-Za-z0-9+/_-](?<![A-Za-z0-9+/_-].)[A-Za-z0-9+/_-]{15,511}+={0,2}(?![A-Za-z0-9+/_-])", re.S)
#: Where a scope ends: a blank line, or the heading of the next section.
BREAK = re.compile(r"\n[ \t\r]*\n|\n(?=\[[^\]\n]{1,64}\][ \t\r]*(?:\n|\Z))")

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, rank of the kind, end) of each secret, in order; matches too short go."""
    found = [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    plain = text.lower()
    if any(name in plain for name in TOLD):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    return sorted(found)


def looks_random(word: str) -> bool:
    """Digits and letters of several kinds, none of them frequent."""
    classes = (any(map(str.isdigit, word)), any(map(str.islower, word)), any(map(str.isupper, word)))
    if sum(classes) < CLASSES or not classes[0]:
        return False
    n = len(word)
    return -sum(c / n * math.log2(c / n) for c in Counter(word).values()) >= RANDOM


class _Taken:
    """Places of a text that are taken, as intervals without overlap."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, _, end in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(end, self.ends[-1])
            else:
                self.starts.append(start)
                self.ends.append(end)

    def take(self, start: int, end: int) -> bool:
        """Take a place if it is free."""
        i = bisect_right(self.starts, start)
        if (i and self.ends[i - 1] > start) or (i < len(self.starts) and self.starts[i] < end):
            return False
        self.starts.insert(i, start)
        self.ends.insert(i, end)
        return True


def weak_parts(text: str, base: list[Span]) -> list[Span]:
    """(start, part, end) of weak candidates: services, assigned values, random-looking words.

    None overlaps a secret or one of those named before it.
    """
    found: list[Span] = []
    at = text.find("://")
    while at >= 0:
        rest = REST.match(text, at + 3)
        if rest and SCHEME.search(text, max(0, at - 16), at):
            found.append((rest.start(3), ENDPOINT, rest.end(3)))
            if rest[1]:
                found += [(rest.start(1), IDENTIFIER, rest.end(1)), (rest.start(2), SECRET, rest.end(2))]
        at = text.find("://", at + 3)
    for m in VALUE.finditer(text):
        name = NAMES.search(text, max(0, m.start() - NAME), m.start())
        if name:
            found.append((m.start(1), name.lastindex - 1, m.end(1)))
    found += [(m.start(), ENDPOINT, m.end()) for m in IP.finditer(text)]
    found += [(m.start(), SECRET, m.end()) for m in WORD.finditer(text) if looks_random(m[0])]
    taken = _Taken(base)
    return sorted(s for s in found if taken.take(s[0], s[2]))


def scopes(text: str, starts: list[int]) -> list[int]:
    """The number of the scope of each start, in rising order of the starts."""
    ends = [m.end() for m in BREAK.finditer(text)] if starts else []
    out, scope = [], 0
    for start in starts:
        while scope < len(ends) and ends[scope] <= start:
            scope += 1
        out.append(scope)
    return out


PART = "struct<scope:int,start:int,end:int,part:int,strong:boolean>"
SCAN = f"doc_id string, mark long, base array<struct<start:int,rank:int,end:int>>, parts array<{PART}>"


def _parts(text: str, base: list[Span]) -> list[dict[str, object]]:
    """All parts of the scopes that hold an identifier and a secret; others link nothing."""
    every = [(s, e, ROLE[k], True) for s, k, e in base]
    every += [(s, e, p, False) for s, p, e in weak_parts(text, base)]
    if {IDENTIFIER, SECRET} - {p for _, _, p, _ in every}:
        return []
    every.sort()
    numbers = scopes(text, [s for s, *_ in every])
    held: dict[int, set[int]] = {}
    for scope, (_, _, part, _) in zip(numbers, every, strict=True):
        held.setdefault(scope, set()).add(part)
    return [
        {"scope": scope, "start": s, "end": e, "part": p, "strong": strong}
        for scope, (s, e, p, strong) in zip(numbers, every, strict=True)
        if {IDENTIFIER, SECRET} <= held[scope]
    ]


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ends = batch["text"].str.len().cumsum() // SLICE
        for _, some in batch.groupby(ends, sort=True):
            base = [base_spans(t) for t in some["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": some["doc_id"].to_numpy(),
                    "mark": some["mark"].to_numpy(),
                    "base": [[{"start": s, "rank": k, "end": e} for s, k, e in spans] for spans in base],
                    "parts": [_parts(t, spans) for t, spans in zip(some["text"], base, strict=True)],
                }
            )


def linked(parts: DataFrame) -> DataFrame:
    """(mark, start, rank, end): weak parts that the parts beside them complete.

    `parts` has mark, scope, start, end, part and strong, each part once. A part is sent
    to its own cell, and looks into that and the two beside it.
    """
    cell = F.floor(F.col("start") / REACH).cast("int")
    beside = parts.select(
        "mark",
        "scope",
        cell.alias("cell"),
        F.col("start").alias("other"),
        F.col("part").alias("kind"),
        F.col("strong").alias("sure"),
    )
    weak = parts.where(~F.col("strong")).drop("strong")
    asking = weak.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    near = F.abs(F.col("start") - F.col("other")) <= REACH

    def some(kind: int, *more: Column) -> Column:
        found = F.col("kind") == kind
        for condition in more:
            found &= condition
        return F.max(found)

    completed = (
        F.when(
            F.col("part") == SECRET, F.col("sure_identifier") | (F.col("identifier") & F.col("endpoint"))
        )
        .when(F.col("part") == IDENTIFIER, F.col("sure_secret") | (F.col("secret") & F.col("endpoint")))
        .otherwise(F.col("identifier") & F.col("secret"))
    )
    return (
        asking.join(beside, ["mark", "scope", "cell"])
        .where(near & (F.col("kind") != F.col("part")))
        .groupBy("mark", "start", "part", "end")
        .agg(
            some(IDENTIFIER).alias("identifier"),
            some(SECRET).alias("secret"),
            some(ENDPOINT).alias("endpoint"),
            some(IDENTIFIER, F.col("sure")).alias("sure_identifier"),
            some(SECRET, F.col("sure")).alias("sure_secret"),
        )
        .where(completed)
        .select("mark", "start", (F.col("part") + len(KINDS)).alias("rank"), "end")
    )


def _names(spans: Column) -> Column:
    """kind:start:end, comma-joined, of (start, rank, end) in order."""
    kinds = F.array(*[F.lit(k) for k in (*KINDS, *PARTS)])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def _count(rank: int) -> Column:
    return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")


def find(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: its secrets and what is linked to a credential.

    Columns: doc_id, mark (hash of the text), n_assign, n_access, n_hex, n_linked (weak
    parts reported), base_sha256 (of the secrets as kind:start:end), spans (secrets and
    linked parts, joined likewise, by start and then kind as listed), found (array of
    start, rank, end). Offsets are code points; secrets of different kinds may overlap,
    linked parts overlap nothing. Null texts count as empty; equal texts have equal
    results; a null doc_id is kept; other columns are not read; an empty table gives no
    rows.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    text = F.coalesce("text", F.lit(""))
    scanned, _ = scratch.keep(
        docs.select(
            F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text")
        )
        .mapInPandas(_scan, SCAN)
        .withColumn("doc_id", F.col("doc_id").cast("long"))
    )
    parts = scanned.select("mark", F.explode("parts").alias("p")).select("mark", "p.*").distinct()
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    # a text that many rows share meets its parts in several tasks
    salt = F.pmod(F.xxhash64("doc_id", "base"), F.lit(SALTS))
    added = (
        linked(parts)
        .groupBy("mark")
        .agg(F.collect_list(F.struct("start", "rank", "end")).alias("added"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    )
    counts = [_count(rank).alias(f"n_{kind}") for rank, kind in enumerate(KINDS)]
    return (
        scanned.select("doc_id", "mark", "base", salt.alias("salt"))
        .join(added, ["mark", "salt"], "left")
        .withColumn("added", F.coalesce("added", none))
        .withColumn("found", F.array_sort(F.concat("base", "added")))
        .select(
            "doc_id",
            "mark",
            *counts,
            F.size("added").cast("long").alias("n_linked"),
            F.sha2(_names(F.col("base")), 256).alias("base_sha256"),
            _names(F.col("found")).alias("spans"),
            "found",
        )
    )
