"""Exact removal of repeated 100-byte strings by column-wise suffix order and common prefixes.

The Burrows-Wheeler transform of a collection can be built column by column: each round
puts one more symbol in front of every document's current suffix, finds the new suffix's
place from the symbols before it, inserts it, and works out how long a prefix it shares
with its neighbours. A window that shares the whole of its length with a neighbour is a
repeat.

A round over a whole corpus would be as many rounds as the longest document has bytes.
So documents are first cut into pieces that can be compared apart from each other:

1. Every window has an anchor, the smallest hash of the 32-byte strings in it. Equal
   windows have equal anchors. Neighbouring windows with one anchor are a run.
2. Runs meet by anchor. Of runs with one content the first stays and the others are
   repeats as a whole. Anchors with a single content cannot repeat and are done.
3. The runs that are left, parts of which may repeat, are cut into pieces of at most
   `PIECE` windows. Pieces of one anchor go to one bucket of bounded size, and each
   bucket builds its transform and common prefixes column by column.

An anchor that very many contents share would make a bucket without bound; its windows
are told apart by a 128-bit hash of all their bytes instead.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headcount.session import Scratch

#: Bytes of a window, and of the strings that anchor it (a power of two).
WINDOW, ANCHOR = 100, 32
#: Bytes worked on at a time; longer documents are worked on in parts.
CHUNK = 1 << 20
#: Windows of a piece, bytes of a bucket, contents of an anchor that share a bucket.
PIECE, BUCKET, CROWD = 100, 1 << 20, 2000

_draw = np.random.default_rng(20)
_BYTES = _draw.integers(0, 2**64, (2, 256), dtype=np.uint64)
_STEPS = _draw.integers(0, 2**63, 8, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(CHUNK, _BASE, np.uint64)]))
_INVERSE = np.cumprod(
    np.concatenate([[np.uint64(1)], np.full(CHUNK, pow(int(_BASE), -1, 1 << 64), np.uint64)])
)
_PLACE = np.uint64(CHUNK - 1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[:-rest], values[rest:]) if rest else values


class Prefixes:
    """Content hashes of any part of a buffer in constant time, 64 bits each."""

    def __init__(self, symbols: np.ndarray, kind: int):
        sums = np.cumsum(_BYTES[kind][symbols] * _POWERS[: len(symbols)])
        self.sums = np.concatenate([[np.uint64(0)], sums])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * _INVERSE[start])


def runs(buffer: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, content, start, windows, may repeat in itself) of the runs in a buffer.

    `ends` are where its documents end; windows do not cross them.
    """
    h = _BYTES[0][buffer]
    reach = 1
    for step in _STEPS[: int(math.log2(ANCHOR))]:
        h = h[:-reach] * step + h[reach:]
        reach *= 2
    h = _mixed(h)
    place = np.arange(len(h), dtype=np.uint64)
    width = WINDOW - ANCHOR + 1
    high = h & ~_PLACE
    first = _smallest(high | place, width)
    last = _PLACE - (_smallest(high | (_PLACE - place), width) & _PLACE)
    value, first = first & ~_PLACE, first & _PLACE
    inside = np.zeros(len(value) + 1, dtype=np.int32)
    starts = np.concatenate([[0], ends[:-1]])
    long = ends - starts >= WINDOW
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - WINDOW + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    cut = np.ones(len(value), dtype=bool)
    cut[1:] = (value[1:] != value[:-1]) | (inside[1:] != inside[:-1])
    # two documents can meet without a gap between their windows only if one is short
    cut[starts[long]] = True
    at = np.flatnonzero(cut)
    count = np.diff(np.append(at, len(value)))
    twice = np.logical_or.reduceat(first != last, at) | (first[at] != first[at + count - 1])
    keep = inside[at]
    at, count, twice = at[keep], count[keep], twice[keep]
    content = Prefixes(buffer, 0).of(at, at + count + WINDOW - 1)
    return h[first[at].astype(np.int64)], content + count.astype(np.uint64), at, count, twice


def _chunks(rows: Iterator[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, ...]]:
    """(buffer, ends, ord, offset): documents put together, long ones in parts."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def out() -> tuple[np.ndarray, ...]:
        return (
            np.frombuffer(b"".join(b for _, _, b in held), dtype=np.uint8),
            np.cumsum([len(b) for _, _, b in held]),
            np.array([o for o, _, _ in held], dtype=np.int64),
            np.array([s for _, s, _ in held], dtype=np.int64),
        )

    for number, text in rows:
        for start in range(0, max(1, len(text) - WINDOW + 1), CHUNK - 2 * WINDOW):
            part = text[start : start + CHUNK - WINDOW - 1]
            if len(part) < WINDOW:
                continue
            if held and size + len(part) > CHUNK:
                yield out()
                held, size = [], 0
            held.append((number, start, part))
            size += len(part)
    if held:
        yield out()


RUNS = "spread long, anchor long, content long, ord long, start long, wound long"


def _find_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All runs. Of a batch's runs with one content all but the first are known repeats.

    `wound` is twice the windows, odd if the run may repeat in itself, and negative for
    known repeats. `spread` deals these apart and brings the others together by anchor.
    """
    for batch in batches:
        parts = []
        rows = zip(batch["ord"], (t.encode() for t in batch["text"]), strict=True)
        for buffer, ends, number, offset in _chunks(rows):
            anchor, content, at, count, twice = runs(buffer, ends)
            of = np.searchsorted(ends, at, side="right")
            start = at - np.concatenate([[0], ends[:-1]])[of] + offset[of]
            parts.append((anchor, content, number[of], start, count << 1 | twice))
        if not parts:
            continue
        anchor, content, number, start, wound = map(np.concatenate, zip(*parts, strict=True))
        order = np.lexsort((start, number, content, anchor))
        anchor, content, number, start, wound = (
            x[order] for x in (anchor, content, number, start, wound)
        )
        again = np.zeros(len(order), dtype=bool)
        again[1:] = (anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1])
        yield pd.DataFrame(
            {
                "spread": np.where(again, _mixed(content + start.astype(np.uint64)), anchor).view(np.int64),
                "anchor": anchor.view(np.int64),
                "content": content.view(np.int64),
                "ord": number,
                "start": start,
                "wound": np.where(again, -wound, wound),
            }
        )


MARKS = "anchor long, ord long, start long, windows long, whole boolean"


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs in order of anchor, content and place: whole repeats, and those to look into.

    A first run of its content is looked into if its anchor has other contents. Between
    batches one run is carried over, so memory is that of a batch.
    """
    names = ["anchor", "ord", "start", "windows", "whole"]
    last = None  # anchor, content, the row of its first run, and whether that went out
    for batch in batches:
        known = batch[batch["wound"] < 0]
        if len(known):
            yield known.assign(windows=-known["wound"] // 2, whole=True)[names]
        batch = batch[batch["wound"] >= 0]
        if not len(batch):
            continue
        anchor, content = batch["anchor"].to_numpy(), batch["content"].to_numpy()
        wound = batch["wound"].to_numpy()
        new_anchor, new = np.ones(len(batch), dtype=bool), np.ones(len(batch), dtype=bool)
        new_anchor[1:] = anchor[1:] != anchor[:-1]
        new[1:] = new_anchor[1:] | (content[1:] != content[:-1])
        carried = last if last is not None and last[0] == anchor[0] else None
        if carried:
            new[0] = content[0] != carried[1]
        group = np.cumsum(new_anchor) - 1
        contents = np.bincount(group, weights=new)
        contents[0] += carried is not None
        look = new & ((contents[group] > 1) | (wound & 1 == 1))
        chosen = look | ~new
        out = pd.DataFrame(
            {
                "anchor": anchor[chosen],
                "ord": batch["ord"].to_numpy()[chosen],
                "start": batch["start"].to_numpy()[chosen],
                "windows": wound[chosen] >> 1,
                "whole": ~new[chosen],
            }
        )
        if carried and not carried[3] and contents[0] > 1:
            out = pd.concat([out, pd.DataFrame([carried[2]], columns=names)])
        firsts = np.flatnonzero(new)
        if len(firsts) and (f := firsts[-1]) >= 0 and anchor[f] == anchor[-1]:
            row = (anchor[f], batch["ord"].iloc[f], batch["start"].iloc[f], wound[f] >> 1, False)
            last = (anchor[f], content[f], row, bool(look[f]))
        else:  # the whole batch goes on with the content carried over
            last = carried and (*carried[:3], carried[3] or contents[0] > 1)
        if len(out):
            yield out


def _inserted(known: np.ndarray, old: np.ndarray, places: np.ndarray, fresh: object) -> np.ndarray:
    """`known` in order, with `fresh` at `places`; `old` says where places are not."""
    out = np.empty(len(old), dtype=known.dtype)
    out[old], out[places] = known, fresh
    return out


def columns(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, offset, common): all suffixes of all pieces in order, and the common prefixes.

    Built column by column: in each round every piece that has a symbol left puts it in
    front of its suffix. common[r] is the length of the prefix that suffix r shares with
    suffix r-1, at most `WINDOW`. Equal suffixes are in order of their pieces.
    """
    lengths = np.array([len(p) for p in pieces], dtype=np.int64)
    stride, n = int(lengths.max()) + 1, len(pieces)
    used, codes = np.unique(np.frombuffer(b"".join(pieces), dtype=np.uint8), return_inverse=True)
    codes = (codes + 1).astype(np.uint8)  # 0 ends a piece; UTF-8 leaves byte values unused
    ends = np.cumsum(lengths)
    # the empty suffixes, in order of their pieces; the symbol before each; common prefixes
    suffix = (np.arange(n) * stride + lengths).astype(np.int32)
    before, common = np.zeros(n, dtype=np.uint8), np.zeros(n, dtype=np.uint8)
    place = np.arange(n)
    for column in range(1, stride):
        live = np.flatnonzero(lengths >= column)
        symbol = codes[ends[live] - column]
        before[place[live]] = symbol
        # suffixes with a symbol before them, by symbol and then in their order, are those
        # that begin with the symbol, in order
        order = np.argsort(before, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(before, minlength=len(used) + 1))])
        shift = n - bounds[1]  # the empty suffixes come first
        seats = np.empty(len(live), dtype=np.int64)
        for s in np.unique(symbol):
            who = np.flatnonzero(symbol == s)
            own = order[bounds[s] : bounds[s + 1]]
            seats[who] = bounds[s] + np.searchsorted(own, place[live[who]])
        # a suffix shares one symbol more with the one before it than what follows does
        asked = np.union1d(seats, seats + 1)
        asked = asked[asked < len(order)]
        inner = asked[~np.isin(asked, bounds)]
        left, right = order[inner - 1] + 1, order[inner] + 1
        down = np.argsort(-left, kind="stable")
        spans = np.stack([left[down], right[down]], axis=1).ravel()
        shared = np.zeros(len(order), dtype=np.uint8)
        if len(inner):
            least = np.minimum.reduceat(np.append(common, np.uint8(0)), spans)[0::2]
            shared[inner[down]] = np.minimum(least.astype(np.int64) + 1, WINDOW)
        place[live] = seats + shift
        old = np.ones(len(suffix) + len(live), dtype=bool)
        old[place[live]] = False
        suffix = _inserted(suffix, old, place[live], live * stride + lengths[live] - column)
        before = _inserted(before, old, place[live], 0)
        common = _inserted(common, old, place[live], 0)
        common[asked + shift] = shared[asked]
    return suffix // stride, suffix % stride, common


def _window_hashes(pieces: list[bytes], kind: int) -> Iterator[np.ndarray]:
    """The content hashes of the windows of each piece."""
    for piece in pieces:
        at = np.arange(len(piece) - WINDOW + 1)
        yield Prefixes(np.frombuffer(piece, dtype=np.uint8), kind).of(at, at + WINDOW)


def _trimmed(pieces: list[bytes], number: np.ndarray, start: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
    """The parts of pieces from their first window with a hash that is met again to the last."""
    hashes = list(_window_hashes(pieces, 0))
    whole = np.concatenate(hashes)
    _, back, counts = np.unique(whole, return_inverse=True, return_counts=True)
    met = counts[back] > 1
    if not met.any():
        return [], number[:0], start[:0]
    of = np.repeat(np.arange(len(pieces)), [len(h) for h in hashes])
    at = np.concatenate([np.arange(len(h)) for h in hashes])[met]
    of = of[met]
    owners, first = np.unique(of, return_index=True)
    last = np.append(first[1:], len(of)) - 1
    parts = [pieces[o][at[a] : at[b] + WINDOW] for o, a, b in zip(owners, first, last, strict=True)]
    return parts, number[owners], start[owners] + at[first]


SPANS = "ord long, start long, stop long"


def _spans(number: np.ndarray, start: np.ndarray) -> pd.DataFrame:
    """Repeated windows as stretches of bytes."""
    order = np.lexsort((start, number))
    number, start = number[order], start[order]
    cut = np.ones(len(number), dtype=bool)
    cut[1:] = (number[1:] != number[:-1]) | (start[1:] > start[:-1] + WINDOW)
    at = np.flatnonzero(cut)
    last = np.append(at[1:], len(number))[: len(at)] - 1
    return pd.DataFrame({"ord": number[at], "start": start[at], "stop": start[last] + WINDOW})


def _repeated(pieces: list[bytes], number: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ord, start) of the windows that repeat earlier ones: neighbours in the order of all
    suffixes that share a whole window, all but the first of them.

    Of equal pieces the first stays, and the windows of the others repeat its own.
    """
    seen: set[bytes] = set()
    first, again = [], []
    for i in np.lexsort((start, number)):
        (again if pieces[i] in seen else first).append(i)
        seen.add(pieces[i])
    size = [len(pieces[i]) - WINDOW + 1 for i in again]
    numbers = [np.repeat(number[again], size)]
    starts = [np.arange(start[i], start[i] + n) for i, n in zip(again, size, strict=True)]
    pieces, number, start = _trimmed([pieces[i] for i in first], number[first], start[first])
    if pieces:
        piece, offset, common = columns(pieces)
        alike = np.cumsum(common < WINDOW)
        full = offset <= np.array([len(p) for p in pieces])[piece] - WINDOW
        alike, number, start = alike[full], number[piece[full]], start[piece[full]] + offset[full]
        order = np.lexsort((start, number, alike))
        alike, number, start = alike[order], number[order], start[order]
        later = np.flatnonzero(alike[1:] == alike[:-1]) + 1
        numbers.append(number[later])
        starts.append(start[later])
    return np.concatenate(numbers), np.concatenate([np.empty(0, np.int64), *starts])


def _sort_bucket(group: pd.DataFrame) -> pd.DataFrame:
    """The repeated windows of a bucket."""
    number, start = group["ord"].to_numpy(np.int64), group["start"].to_numpy(np.int64)
    return _spans(*_repeated(group["piece"].to_list(), number, start))


def _cut_up(start: int, stop: int) -> list[tuple[int, int]]:
    """Stretches of at most `PIECE` windows, as (first window, end of the last one)."""
    return [
        (at, min(at + PIECE, stop) + WINDOW - 1) for at in range(start, stop, PIECE)
    ]


def _reduced(long: list[tuple]) -> tuple[pd.DataFrame, list[tuple]]:
    """Repeats among the pieces of long runs, bucket by bucket, and the pieces that are left.

    A piece is (anchor, crowd, ord, start, bytes). Whatever repeats an earlier window here
    does so in the corpus; what is left goes on to meet the others.
    """
    long = sorted(long, key=lambda piece: piece[0])
    found, left, at = [], [], 0
    while at < len(long):
        end, size = at, 0
        while end < len(long) and (end == at or size < BUCKET):
            size += len(long[end][4])
            end += 1
        group = long[at:end]
        at = end
        again = _repeated(
            [p[4] for p in group], np.array([p[2] for p in group]), np.array([p[3] for p in group])
        )
        found.append(_spans(*again))
        order = np.lexsort((again[1], again[0]))
        numbers, starts = again[0][order], again[1][order]
        for anchor, crowd, number, start, piece in group:
            low, high = np.searchsorted(numbers, [number, number + 1])
            own = starts[low:high]
            low, high = np.searchsorted(own, [start, start + len(piece) - WINDOW + 1])
            kept = np.ones(len(piece) - WINDOW + 1, dtype=bool)
            kept[own[low:high] - start] = False
            edges = np.flatnonzero(np.diff(kept, prepend=False, append=False)).reshape(-1, 2)
            left += [
                (anchor, crowd, number, start + a, piece[a : b + WINDOW - 1]) for a, b in edges
            ]
    return pd.concat(found), left


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        yield pd.DataFrame(
            {"ord": batch["ord"], "packed": [squeeze.compress(t.encode()) for t in batch["text"]]}
        )


CUTS = "bucket long, ord long, start long, piece binary, low long, high long"


#: What a row of a cut holds, by its bucket: pieces have buckets from 0 on.
CROWDED, FOUND = -1, -2


def _cut(buckets: int):
    """Pieces of the runs to look into, and hashes of the windows of crowded anchors.

    A run of many windows repeats in itself, like a word said a thousand times. Such runs
    are compared among themselves first, and what is left of them goes on.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loosen = zstandard.ZstdDecompressor()
        for batch in batches:
            pieces, long = [], []
            for number, packed, looks in zip(batch["ord"], batch["packed"], batch["looks"], strict=True):
                text = loosen.decompress(packed)
                for look in looks:
                    start, windows = look["start"], look["windows"]
                    (long if windows > PIECE else pieces).extend(
                        (look["anchor"], look["crowd"], number, a, text[a:b])
                        for a, b in _cut_up(start, start + windows)
                    )
            if long:
                found, left = _reduced(long)
                pieces += left
                spans = found.rename(columns={"stop": "low"})
                yield spans.assign(bucket=FOUND, piece=b"", high=0)
            rows = [(p[0] % buckets, *p[2:]) for p in pieces if not p[1]]
            crowds = [p[2:] for p in pieces if p[1]]
            yield pd.DataFrame(rows, columns=["bucket", "ord", "start", "piece"]).assign(low=0, high=0)
            if crowds:
                number, start, pieces = zip(*crowds, strict=True)
                size = [len(p) - WINDOW + 1 for p in pieces]
                yield pd.DataFrame(
                    {
                        "bucket": CROWDED,
                        "ord": np.repeat(number, size),
                        "start": np.concatenate([np.arange(s, s + n) for s, n in zip(start, size, strict=True)]),
                        "piece": b"",
                        "low": np.concatenate(list(_window_hashes(pieces, 0))).view(np.int64),
                        "high": np.concatenate(list(_window_hashes(pieces, 1))).view(np.int64),
                    }
                )

    return cut


RESULT = "ord long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _finish(with_text: bool):
    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loosen = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for number, packed, spans in zip(batch["ord"], batch["packed"], batch["spans"], strict=True):
                text, end, removed, count, kept = loosen.decompress(packed), 0, 0, 0, []
                found = [] if spans is None else sorted((s["start"], s["stop"]) for s in spans)
                stop = -1
                for a, b in found:
                    if a > stop:
                        count += 1
                        kept.append(text[end:a])
                    removed += max(0, b - max(a, stop))
                    stop = end = max(stop, b)
                kept = b"".join([*kept, text[end:]])
                rows.append(
                    (number, len(text), removed, count, hashlib.sha256(kept).hexdigest(), kept if with_text else b"")
                )
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])

    return finish


def _numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(ord, doc_id, text, copies): texts in order of doc_id, equal rows once.

    Where doc_id is unique it is the order. Otherwise rows are sorted in ranges: null
    doc_ids last, and the texts of one doc_id by hash.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    count, known, distinct = rows.agg(
        F.count(F.lit(1)), F.count("doc_id"), F.count_distinct("doc_id")
    ).first()
    if count == known == distinct:
        return rows.select(F.col("doc_id").alias("ord"), "doc_id", "text", F.lit(1).cast("long").alias("copies"))
    mark = F.xxhash64("text")
    once = rows.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    order = [F.col("doc_id").asc_nulls_last(), mark.asc(), F.col("text").asc()]
    stored, _ = scratch.keep(
        once.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(F.monotonically_increasing_id().alias("ord"), "doc_id", "text", "copies")
    )
    return stored


def _struct(*names: str) -> Column:
    return F.collect_list(F.struct(*names))


def repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per row of `docs`: what is left without bytes that repeat earlier ones.

    A byte goes if a string of `WINDOW` bytes that covers it also starts earlier: in a
    smaller doc_id, or before in the same text. Null doc_ids come last; texts that share
    a doc_id come in order of their hash, and of equal rows one counts as earlier than
    the others. Columns: doc_id, n_bytes, n_removed, n_spans (stretches of removed
    bytes), kept_sha256 (of what is left), and kept (those bytes) if asked for. Texts are
    whole UTF-8; null counts as empty. Only doc_id and text are read; an empty table
    gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    numbered = _numbered(docs, scratch)
    found = numbered.select("ord", "text").mapInPandas(_find_runs, RUNS)
    order = ["anchor", "content", "ord", "start"]
    marks, _ = scratch.keep(
        found.repartition("spread").sortWithinPartitions("spread", *order).mapInPandas(_judge, MARKS)
    )
    whole = marks.where("whole").select(
        "ord", "start", (F.col("start") + F.col("windows") + WINDOW - 1).alias("stop")
    )
    packed = numbered.select("ord", "text").mapInPandas(_pack, "ord long, packed binary")
    looks = marks.where("not whole").drop("whole")
    size = F.col("windows") + (WINDOW - 1) * F.ceil(F.col("windows") / F.lit(PIECE))
    total = looks.agg(F.sum(size)).first()[0]
    spans = whole
    if total:
        crowds = (
            looks.groupBy("anchor")
            .agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > CROWD)
            .select("anchor", F.lit(True).alias("crowd"))
        )
        asked = (
            looks.join(crowds, "anchor", "left")
            .withColumn("crowd", F.coalesce("crowd", F.lit(False)))
            .groupBy("ord")
            .agg(_struct("anchor", "start", "windows", "crowd").alias("looks"))
        )
        cuts, _ = scratch.keep(
            packed.join(asked, "ord").mapInPandas(_cut(math.ceil(total / BUCKET)), CUTS)
        )
        within = (
            cuts.where(F.col("bucket") >= 0)
            .select("bucket", "ord", "start", "piece")
            .groupBy("bucket")
            .applyInPandas(_sort_bucket, SPANS)
        )
        crowd = cuts.where(F.col("bucket") == CROWDED).select("low", "high", "ord", "start")
        first = crowd.groupBy("low", "high").agg(
            F.min(F.struct("ord", "start")).alias("first"), F.count(F.lit(1)).alias("n")
        )
        apart = (
            crowd.join(first.where(F.col("n") > 1), ["low", "high"])
            .where(F.struct("ord", "start") > F.col("first"))
            .select("ord", "start", (F.col("start") + WINDOW).alias("stop"))
        )
        own = cuts.where(F.col("bucket") == FOUND).select("ord", "start", F.col("low").alias("stop"))
        spans = whole.union(within).union(apart).union(own)
    per_text = spans.groupBy("ord").agg(_struct("start", "stop").alias("spans"))
    done = packed.join(per_text, "ord", "left").mapInPandas(_finish(with_text), RESULT)
    names = numbered.select("ord", "doc_id", "copies")
    nothing = hashlib.sha256(b"").hexdigest()
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    gone = (F.col("copy") > 1) & (F.col("n_bytes") >= WINDOW)
    out = (
        done.join(names, "ord")
        .withColumn("copy", copy)
        .select(
            "doc_id",
            "n_bytes",
            F.when(gone, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
            F.when(gone, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
            F.when(gone, F.lit(nothing)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
            F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
        )
    )
    return out if with_text else out.drop("kept")
