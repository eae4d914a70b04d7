"""Spelling variants against a plain version that compares words by deleting letters."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from headcount.llm import spelling
from headcount.llm.queries import op13_spelling

SCHEMA = "doc_id long, text string, n long, word string, form string"


def plain_words(rows):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 6 and n >= 5}


def plain_variants(words):
    """Near words meet at what is left of them without one letter."""
    at = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            at["replace", i, w[:i] + w[i + 1 :]].add(w)
            at["delete", w[:i] + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for key, group in at.items():
        if key[0] == "replace":
            for w in group:
                near[w] |= group - {w}
        elif key[1] in words:
            for w in group:
                near[w].add(key[1])
                near[key[1]].add(w)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), None if form[w] is None else words[form[w]]))
    return out


def found(frame):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


def corpus():
    draw = random.Random(5)
    parts = ["an", "ba", "cé", "do", "en", "fi", "ga", "ÿx", "ion", "ment", "s"]
    base = ["".join(draw.choice(parts) for _ in range(draw.randint(3, 6))) for _ in range(150)]
    base += ["planet", "planets", "plant", "planeta", "planett", "zzzzzz", "zzzzzzz", "zzzzzzzz"]
    texts = []
    for i, w in enumerate(base):
        for near in {w, w[:-1], w + "s", w[1:], w[:2] + "x" + w[2:], w[:3] + "y" + w[4:]}:
            texts += [near.upper() if i % 5 == 0 else near] * draw.choice([4, 5, 6, 30, 160])
    draw.shuffle(texts)
    rows = [(i, " ".join(texts[i * 40 : i * 40 + 40])) for i in range(len(texts) // 40 + 1)]
    rows += [(None, "planet " * 70), (7, None), (8, ""), (9, "1 2, -"), (10, "q" * 100_000 + " planet×÷ " * 6)]
    return rows + [rows[0], rows[0]]


@pytest.mark.parametrize("crowd,frequent,held", [(100, 32, 200_000), (1, 32, 50), (3, 2, 200_000), (100, 10**9, 200_000)])
def test_against_plain_version(spark, monkeypatch, crowd, frequent, held):
    monkeypatch.setattr(spelling, "CROWD", crowd)
    monkeypatch.setattr(spelling, "FREQUENT", frequent)
    monkeypatch.setattr(spelling, "HELD", held)
    rows = corpus()
    frame = spark.createDataFrame([(d, t, 1, "w", "f") for d, t in rows], SCHEMA).repartition(5)
    want = plain_variants(plain_words(rows))
    assert len(want) > 200 and any(r[2] != (r[1] or r[0]) for r in want)
    assert found(spelling.variants(frame)) == want


def test_query_against_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert found(op13_spelling(spark, "/root/testdata/sf0.01")) == plain_variants(plain_words(rows))


def test_empty(spark):
    for rows in ([], [(1, None, 0, "", "")], [(1, "few words", 0, "", "")]):
        assert spelling.variants(spark.createDataFrame(rows, SCHEMA)).collect() == []


LETTERS = st.text("abcé", min_size=6, max_size=14)


@settings(max_examples=400, deadline=None)
@given(LETTERS, st.integers(0, 13), st.sampled_from("abcé"), st.sampled_from("idr"), st.sets(st.text("abcé$", min_size=3, max_size=4), max_size=40))
def test_one_edit_leaves_a_listed_gram(word, at, letter, kind, frequent):
    """Words one edit apart share a list, whatever the dictionary."""
    at = min(at, len(word) - 1)
    other = {"i": word[:at] + letter + word[at:], "d": word[:at] + word[at + 1 :], "r": word[:at] + letter + word[at + 1 :]}[kind]
    if other == word or len(other) < 6:
        return
    short, long = sorted([word, other], key=len)
    known = dict.fromkeys(frequent, 40)
    import pandas as pd

    lists = next(spelling._listed(known)(iter([pd.DataFrame({"word": [short, long], "n": [5, 5]})])))
    own = lists[lists.role == spelling.OWN]
    role = spelling.OWN if len(short) == len(long) else spelling.SHORTER
    mine = set(lists[(lists.word == short) & (lists.role == role)].key)
    assert mine & set(own[own.word == long].key)
