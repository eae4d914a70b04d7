"""Personal data and the terms that give it away, by information content.

Patterns find the protected entities: addresses, numbers of cards and phones. A term
that keeps appearing beside one entity and seldom without it reveals that entity even
where the entity itself is masked. How much is measured on the whole corpus: the
pointwise mutual information of term and entity, as a share of the information the
entity carries. Terms at or above the threshold are masked wherever they are written,
in texts without the entity too.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headcount.session import Scratch

#: Kinds in the order that breaks ties of equal starts; terms come last.
KINDS = ("email", "ip", "card", "phone")
TERM_RANK = len(KINDS)

#: Words on either side of an entity that count as beside it, and characters they are in.
BESIDE, REACH = 8, 160
#: Bits that a reader of a term must lack to know the entity, at least.
LACKING = 1.0
#: Disclosing terms that each task may hold as a set.
BROADCAST_TERMS = 200_000
#: Characters of text whose results leave a task together.
SLICE = 1_000_000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")
DIGITS = re.compile(r"[0-9]")

Span = tuple[int, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the address pattern: every @ is tried once, so long runs stay linear."""
    end = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = max(at + 1, end)


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, rank of the kind, end) of each entity, in order; matches that fail a check go."""
    found: list[Span] = []
    if "@" in text:
        found += [(s, 0, e) for s, e in _emails(text)]
    if DIGITS.search(text):
        found += [
            (m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(_byte, m[0].split(".")))
        ]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [
                (m.start(), 3, m.end())
                for m in PHONE.finditer(text)
                if 10 <= sum(map(str.isdigit, m[0])) <= 15
            ]
    found.sort()
    return found


def _entity(kind: int, value: str) -> int:
    """A stable number for an entity, whatever its spelling."""
    plain = value.lower() if kind < 2 else re.sub(r"[^0-9]", "", value)
    number = xxhash.xxh64_intdigest(f"{KINDS[kind]}:{plain}")
    return number - (1 << 64) if number >> 63 else number


def _beside(text: str, spans: list[Span], start: int, end: int) -> list[tuple[str, int, int]]:
    """The terms beside a span, but for those within entities."""
    low, high = max(0, start - REACH), min(len(text), end + REACH)
    before = [(m[0], m.start(), m.end()) for m in TERM.finditer(text, low, start)]
    after = [(m[0], m.start(), m.end()) for m in TERM.finditer(text, end, high)]
    # a word cut by the reach is none
    before = [w for w in before if w[1] > low or low == 0][-BESIDE:]
    after = [w for w in after if w[2] < high or high == len(text)][:BESIDE]
    near = [s for s in spans if s[0] < high and s[2] > low]
    return [
        (w.lower(), a, b)
        for w, a, b in before + after
        if not any(a < e and s < b for s, _, e in near)
    ]


MENTION = "struct<entity:long,context:long,terms:array<string>>"
SCAN = f"doc_id long, mark long, base array<struct<start:int,rank:int,end:int>>, mentions array<{MENTION}>"


def _slices(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Runs of rows with about `SLICE` characters: what a text yields may exceed it by far."""
    ends = batch["text"].str.len().cumsum() // SLICE
    for _, part in batch.groupby(ends, sort=True):
        yield part


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part in _slices(batch):
            yield _scanned(part)


def _scanned(batch: pd.DataFrame) -> pd.DataFrame:
    base, mentions = [], []
    for text in batch["text"]:
        spans = base_spans(text)
        beside: dict[int, set[str]] = {}
        for start, kind, end in spans:
            entity = _entity(kind, text[start:end])
            near = {w for w, _, _ in _beside(text, spans, start, end)}
            beside.setdefault(entity, set()).update(near)
        base.append([{"start": s, "rank": k, "end": e} for s, k, e in spans])
        mentions.append(
            [
                {
                    "entity": entity,
                    "context": xxhash.xxh64_intdigest(" ".join(sorted(near))) >> 1,
                    "terms": sorted(near),
                }
                for entity, near in beside.items()
            ]
        )
    return pd.DataFrame(
        {"doc_id": batch["doc_id"].to_numpy(), "mark": batch["mark"].to_numpy(), "base": base, "mentions": mentions}
    )


def _frequencies(terms: frozenset[str] | None) -> Callable:
    """In how many documents of a slice each term is; of the given terms, or of all."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _slices(batch):
                seen: Counter[str] = Counter()
                for text in part["text"]:
                    own = {w.lower() for w in TERM.findall(text)}
                    seen.update(own if terms is None else own & terms)
                if seen:
                    yield pd.DataFrame({"term": list(seen), "n": list(seen.values())})

    return count


def _places(terms: frozenset[str] | None) -> Callable:
    """Where each term of a text is written; of the given terms, or of all."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _slices(batch):
                marks, found, places = [], [], []
                for mark, text in zip(part["mark"], part["text"], strict=True):
                    own: dict[str, list[dict[str, int]]] = {}
                    for m in TERM.finditer(text):
                        word = m[0].lower()
                        if terms is None or word in terms:
                            own.setdefault(word, []).append({"start": m.start(), "end": m.end()})
                    marks += [mark] * len(own)
                    found += own
                    places += own.values()
                if marks:
                    yield pd.DataFrame({"mark": marks, "term": found, "places": places})

    return find


def _held(terms: DataFrame) -> frozenset[str] | None:
    """The terms as a set if they are few enough to be sent to each task."""
    found = terms.limit(BROADCAST_TERMS + 1).collect()
    return None if len(found) > BROADCAST_TERMS else frozenset(r["term"] for r in found)


def disclosing(scanned: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(entity, term, lacking): pairs that leave fewer bits than the threshold.

    Frequencies are of documents, whole texts and all of them; pairs are counted where
    the term is beside the entity. Every pair is judged. P(entity | term), the share of a
    term's documents that have the entity beside it, is lowered as if one more surrounding
    had the term alone: against one surrounding, which may be chance or copies, that is a
    half, and against many it is nothing.
    """
    mentions = scanned.select(F.explode("mentions").alias("m")).select("m.*")
    pairs, _ = scratch.keep(
        mentions.select("entity", "context", F.explode("terms").alias("term"))
        .groupBy("entity", "term", "context")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("entity", "term")
        .agg(F.sum("n").alias("n_pair"), F.count(F.lit(1)).alias("contexts"))
    )
    if pairs.isEmpty():
        return pairs.select("entity", "term", F.lit(0.0).alias("lacking"))
    asked = pairs.select("term").distinct()
    held = _held(asked)
    counted = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInPandas(
        _frequencies(held), "term string, n long"
    )
    if held is None:
        counted = counted.join(asked, "term", "left_semi")
    per_term = counted.groupBy("term").agg(F.sum("n").alias("n_term"))
    per_term = per_term if held is None else F.broadcast(per_term)
    share = F.col("n_pair") / F.col("n_term") * F.col("contexts") / (F.col("contexts") + 1)
    return (
        pairs.join(per_term, "term")
        .select("entity", "term", (-F.log2(share)).alias("lacking"))
        .where(F.col("lacking") < LACKING)
    )


def _names(spans: Column, last: str) -> Column:
    """kind:start:end, comma-joined, of (start, rank, end) in order."""
    kinds = F.array(*[F.lit(k) for k in (*KINDS, last)])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def find(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: what is to be masked.

    Columns: doc_id, mark (hash of the text), n_email, n_ip, n_card, n_phone, n_term,
    base_sha256 (of the entities as kind:start:end), spans (entities and terms, joined
    likewise), masks (array of start, rank, end). Offsets are code points. Null texts
    count as empty; equal texts have equal results; other columns are not read; an
    empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    text = F.coalesce("text", F.lit(""))
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text")
    )
    scanned, _ = scratch.keep(
        source.withColumn("doc_id", F.col("doc_id").cast("string"))
        .mapInPandas(_scan, SCAN.replace("doc_id long", "doc_id string"))
        .withColumn("doc_id", F.col("doc_id").cast("long"))
    )
    told, _ = scratch.keep(disclosing(scanned, docs, scratch))
    terms, _ = scratch.keep(told.select("term").distinct())
    held = _held(terms)
    written = source.select("mark", "text").mapInPandas(
        _places(held), "mark long, term string, places array<struct<start:int,end:int>>"
    )
    if held is None:
        written = written.join(terms, "term", "left_semi")
    # a set: equal texts give the same places
    added = (
        written.groupBy("mark")
        .agg(F.flatten(F.collect_set("places")).alias("places"))
        .select(
            "mark",
            F.transform(
                "places", lambda t: F.struct(t["start"].alias("start"), F.lit(TERM_RANK).alias("rank"), t["end"].alias("end"))
            ).alias("found"),
        )
    )
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    outside = F.filter(
        "found",
        lambda t: ~F.exists("base", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])),
    )
    counts = [_count(rank).alias(f"n_{kind}") for rank, kind in enumerate(KINDS)]
    return (
        scanned.select("doc_id", "mark", "base")
        .join(added, "mark", "left")
        .withColumn("added", F.when(F.size("base") == 0, F.col("found")).otherwise(outside))
        .withColumn("masks", F.array_sort(F.concat("base", F.coalesce("added", none))))
        .select(
            "doc_id",
            "mark",
            *counts,
            F.size(F.coalesce("added", none)).cast("long").alias("n_term"),
            F.sha2(_names(F.col("base"), "term"), 256).alias("base_sha256"),
            _names(F.col("masks"), "term").alias("spans"),
            "masks",
        )
    )


def _count(rank: int) -> Column:
    return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")


def masked(text: str, masks: list) -> str:
    """The text with entities as their kind and terms as their form, longer spans first."""
    out, end = [], 0
    for mask in masks:
        start, rank, stop = mask["start"], mask["rank"], mask["end"]
        if start < end:
            end = max(end, stop)
            continue
        if rank < TERM_RANK:
            label = f"<{KINDS[rank]}>"
        else:
            label = "<Name>" if text[start].isupper() else "<word>"
        out += [text[end:start], label]
        end = stop
    return "".join([*out, text[end:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """`docs` with entities masked by kind and disclosing terms generalised to their form.

    Null texts stay null. Rows keep their other columns; order is not kept.
    """
    masks = find(docs).select("mark", "masks").where(F.size("masks") > 0)
    masks = masks.groupBy("mark").agg(F.first("masks").alias("pii_masks"))

    @F.pandas_udf("string")
    def apply(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spans in batches:
            yield pd.Series(
                [t if t is None or s is None else masked(t, s) for t, s in zip(texts, spans, strict=True)]
            )

    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    return (
        docs.join(masks.withColumnRenamed("mark", "pii_mark"), mark == F.col("pii_mark"), "left")
        .withColumn("text", apply("text", "pii_masks"))
        .select(*docs.columns)
    )
