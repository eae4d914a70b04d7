"""SimHash groups against brute force over all pairs."""

from __future__ import annotations

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from headcount.llm import simhash
from headcount.session import Scratch

SCHEMA = "doc_id long, text string, fp string, root string"


def plain_print(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in root:
        for b in root:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return {f: find(f) for f in root}


def documents():
    draw = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(draw.choices(words, k=draw.randint(0, 60)))) for i in range(150)]
    rows += [(200 + i, rows[i][1].upper().replace(" ", "\n")) for i in range(20)]
    rows += [(300 + i, rows[40 + i][1] + " tail") for i in range(30)]
    rows += [(400, None), (401, ""), (402, " \t\r\x0b\x0c\n"), (None, "Éa b c d e"), (3, rows[3][1])]
    rows += [(500, "one"), (501, "one two"), (502, "ONE  two"), (503, "é" * 200_000)]
    rows += [(600, "a b " * 70_000)]
    return [(d, t, "x", "y") for d, t in rows]


@pytest.mark.parametrize("crowd", [64, 1])
def test_against_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rows = documents()
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    prints = [plain_print(t) for _, t, _, _ in rows]
    group = plain_groups(prints)
    least = {}
    for (d, _, _, _), f in zip(rows, prints, strict=True):
        if d is not None:
            least[group[f]] = min(d, least.get(group[f], d))
    want = sorted(
        (str(d), f"{f:016x}", least.get(group[f]))
        for (d, _, _, _), f in zip(rows, prints, strict=True)
    )
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want


@pytest.mark.parametrize("crowd", [64, 1])
def test_links_find_every_close_pair(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    draw = random.Random(1)
    prints = set()
    for _ in range(30):
        base = draw.getrandbits(64)
        for _ in range(8):
            prints.add(base)
            base ^= 1 << draw.randrange(64)
            if draw.random() < 0.5:
                base ^= 1 << draw.randrange(64)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in prints]
    got = simhash.groups(spark.createDataFrame(signed, "fp long"), Scratch(spark, "t")).collect()
    group = plain_groups(prints)
    mine = {r.fp % (1 << 64): r.root for r in got}
    assert len({(group[f], mine[f]) for f in prints}) == len(set(group.values())) == len(set(mine.values()))


def test_keep_one(spark):
    rows = documents()
    frame = spark.createDataFrame(rows, SCHEMA)
    found = simhash.near_duplicates(frame)
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    want = {r.c for r in found.groupBy("root").agg(F.min("component_id").alias("c")).collect()}
    got = [r.doc_id for r in kept.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_empty(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(frame).collect() == []
    assert simhash.keep_one(frame).collect() == []
