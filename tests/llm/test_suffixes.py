"""Repeated strings against brute force, and the column-wise order against sorting."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from headcount.llm import suffixes

SCHEMA = "doc_id long, text string, ord string, n_bytes string"


@pytest.mark.parametrize("seed", range(6))
def test_columns_equal_sorting(seed):
    draw = random.Random(seed)
    pieces = [bytes(draw.choices(b"ab\x00", k=draw.randint(1, 30))) for _ in range(25)]
    pieces += [pieces[0], pieces[1][2:] or b"a", b"a" * 150, b"a" * 130]
    want = sorted((p[i:], n, i) for n, p in enumerate(pieces) for i in range(len(p) + 1))
    piece, offset, common = suffixes.columns(pieces)
    assert list(zip(piece, offset)) == [(n, i) for _, n, i in want]

    def share(a, b):
        n = 0
        while n < min(len(a), len(b), suffixes.WINDOW) and a[n] == b[n]:
            n += 1
        return n

    assert list(common) == [0] + [share(a[0], b[0]) for a, b in zip(want, want[1:])]


def plain(rows, width=100):
    """By doc_id, nulls last; of equal rows one is earlier than the others."""
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    seen, out = set(), []
    for doc_id, text, *_ in ordered:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), dtype=bool)
        for i in range(len(raw) - width + 1):
            if raw[i : i + width] in seen:
                gone[i : i + width] = True
            seen.add(raw[i : i + width])
        kept = bytes(np.frombuffer(raw, dtype=np.uint8)[~gone])
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((str(doc_id), len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed=0):
    draw = random.Random(seed)
    words = [f"{a}{b}" for a in ("th", "er", "in", "on", "é") for b in ("al", "o", "ent", "is")]

    def text(n):
        return " ".join(draw.choices(words, k=n))

    shared = [text(40) for _ in range(4)] + ["one short line that everybody has, less than a window long"]
    rows = []
    for i in range(150):
        parts = [text(draw.randint(1, 60)) for _ in range(3)]
        if draw.random() < 0.6:
            parts.insert(1, draw.choice(shared))
        rows.append((i, "\n".join(parts)))
    rows += [(200 + i, rows[i][1]) for i in range(15)]
    for i in range(15):  # near copies: a word is changed somewhere
        some = rows[20 + i][1].split(" ")
        some[draw.randrange(len(some))] = "changed"
        rows.append((300 + i, " ".join(some)))
    rows += [(400, None), (401, ""), (402, "x" * 99), (403, "x" * 100), (404, "x" * 101), (405, "ab" * 400)]
    rows += [(406, (text(12) + " ") * 30), (407, rows[3][1][5:] + rows[4][1][:-3]), (None, rows[7][1][:150] + "tail")]
    return [(d, t, "clash", "clash") for d, t in rows]


def run(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = suffixes.repeats(frame).collect()
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)


def test_against_brute_force(spark):
    rows = corpus()
    assert run(spark, rows) == plain(rows)
    some = [r for r in rows if r[0] is not None]
    assert run(spark, some) == plain(some)


@pytest.mark.parametrize(("name", "value"), [("CROWD", 1), ("PIECE", 7), ("BUCKET", 3000), ("CHUNK", 1 << 20)])
def test_splits_change_nothing(spark, monkeypatch, name, value):
    monkeypatch.setattr(suffixes, name, value)
    rows = corpus(1)
    assert run(spark, rows) == plain(rows)


def test_repeated_rows(spark):
    rows = corpus(2)[:30]
    rows += rows[:5] + [(400, "short", "", "")] * 3
    assert run(spark, rows) == plain(rows)


def test_long_document():
    """A document longer than a chunk is worked on in parts that lose no window."""
    draw = random.Random(3)
    base = "".join(draw.choices("abcdefgh ", k=3000))
    text = ("".join(draw.choices("abcdefgh ", k=1_050_000)) + base + "z" * 40_000 + base).encode()
    windows = 0
    for buffer, ends, _, offset in suffixes._chunks(iter([(1, text)])):
        anchor, _, at, count, _ = suffixes.runs(buffer, ends)
        assert all(buffer.tobytes()[: ends[0]] == text[o : o + ends[0]] for o in offset[:1])
        windows += count.sum()
    assert windows == len(text) - suffixes.WINDOW + 1


def test_judge_in_any_batches(spark):
    """Whatever the batches, the same runs are repeats or looked into."""
    import pandas as pd

    draw = np.random.default_rng(5)
    rows = pd.DataFrame(
        {
            "anchor": draw.integers(0, 30, 400),
            "content": draw.integers(0, 3, 400),
            "ord": draw.permutation(400),
            "start": 0,
            "wound": 2 * draw.integers(1, 9, 400) + (draw.random(400) < 0.05),
        }
    ).sort_values(["anchor", "content", "ord"], ignore_index=True)

    def judged(size):
        parts = [rows[i : i + size].reset_index(drop=True) for i in range(0, len(rows), size)]
        out = pd.concat(suffixes._judge(iter(parts)))
        return sorted(map(tuple, out[["anchor", "ord", "windows", "whole"]].astype(int).to_numpy().tolist()))

    want = judged(1000)
    assert len({o for _, o, _, _ in want}) == len(want)
    assert all(judged(size) == want for size in (1, 2, 3, 7, 50))


def test_empty(spark):
    assert run(spark, []) == []
