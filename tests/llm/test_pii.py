"""Entities against the plain patterns, disclosure against counting by hand."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from headcount.llm import pii

SCHEMA = "doc_id long, text string, mark string, spans string"

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def plain_spans(text):
    found = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 14 <= len(digits) <= 19 and plain_luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((m.start(), rank, m.end()))
    return sorted(found)


PARTS = st.sampled_from(
    ["a", "B.c", "@", "x@y.de", ".", "-", " ", "+", "1", "255", "256", "4111 1111 1111 1111", "é", "(0)", "%", "\n",
     "+49 30 1234567", "10.0.0.1", "0001", "12345678901234567890", "..", "--", "٣", "_"]
)


@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS, max_size=14).map("".join))
def test_base_spans_equal_plain_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_long_runs_are_linear():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1 " * 60_000, "a@" * 100_000, "1 " * 100_000):
        pii.base_spans(text)


def rows():
    filler = "plain words of every kind stand here for nothing at all".split()
    out = []
    for i in range(60):
        out.append((i, f"{filler[i % 11]} said {filler[(i * 3) % 11]} number {filler[(i * 7) % 11]} apart"))
    for i in range(5):
        out.append((100 + i, f"Note{i} {filler[i]}: Zaphod wrote from z@example.org on the {filler[i + 2]} of day"))
    out += [(200 + i, "copied Quux line w@example.org beside it") for i in range(6)]
    out += [(300, None), (301, ""), (None, "call +1 (555) 123-4567 now"), (302, "x" * 100_000)]
    return [(d, t, "clash", "clash") for d, t in out]


def test_against_counts(spark):
    data = rows()
    frame = spark.createDataFrame(data, SCHEMA)
    got = pii.find(frame.repartition(4)).collect()
    assert len(got) == len(data)
    words = Counter(w for _, t, _, _ in data for w in set(pii.TERM.findall((t or "").lower())))
    beside = {"note", "zaphod", "wrote", "from", "the", "day"}
    # five surroundings, and one more that might have the term alone
    told = {w for w in beside if -math.log2(5 / words[w] * 5 / 6) < pii.LACKING}
    assert "zaphod" in told
    by_id = {r.doc_id: r for r in got}
    for d, text, _, _ in data:
        r, text = by_id[d], text or ""
        base = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in plain_spans(text))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        spans = [s for s in r.spans.split(",") if s]
        assert ",".join(s for s in spans if not s.startswith("term")) == base
        terms = {text[int(s.split(":")[1]) : int(s.split(":")[2])].lower() for s in spans if s.startswith("term")}
        # copies of one line are one surrounding, which is no support
        assert terms == (told if d is not None and 100 <= d < 105 else set())
        assert r.n_term == sum(s.startswith("term") for s in spans)
        counts = Counter(s.split(":")[0] for s in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in pii.KINDS)


def test_sanitise(spark):
    frame = spark.createDataFrame(rows(), SCHEMA)
    got = pii.sanitise(frame)
    assert got.columns == frame.columns
    text = {r.doc_id: r.text for r in got.collect()}
    assert "example.org" not in text[101] and "Zaphod" not in text[101] and "<email>" in text[101]
    assert text[300] is None and text[None] == "call <phone> now"


def test_empty(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert pii.find(frame).collect() == [] and pii.sanitise(frame).collect() == []


@pytest.mark.parametrize("others", [0, 50, 3000])
@pytest.mark.parametrize("held", [200_000, 0])
def test_verdict_does_not_depend_on_other_documents(spark, monkeypatch, others, held):
    monkeypatch.setattr(pii, "BROADCAST_TERMS", held)
    monkeypatch.setattr(pii, "SLICE", 2_000)
    data = [(i, f"plain words number {i} of a large table", "", "") for i in range(others)]
    data += [(9000, "Zaphod signs as z@example.org each day", "", ""), (9001, "z@example.org or Zaphod, both", "", "")]
    data += [(9002, "only zaphod", "", ""), (9003, "hapax beside once@example.org", "", "")]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(data, SCHEMA)).collect()}
    # two of three documents, lowered to 4/9, leave 1.2 bits; without the third, 2/3 leave 0.6
    assert [got[i].n_term for i in (9000, 9001, 9002, 9003)] == [0, 0, 0, 0]
    data.remove((9002, "only zaphod", "", ""))
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(data, SCHEMA)).collect()}
    assert [got[i].n_term for i in (9000, 9001, 9003)] == [1, 1, 0]
    assert not any(r.n_term for i, r in got.items() if i < 9000)


def test_every_pair_is_judged_and_masked_everywhere(spark):
    """Two surroundings are enough for a term of its own; it is masked far off and alone."""
    far = "plain words " * 40
    data = [(i, f"plain words number {i} of a large table", "", "") for i in range(400)]
    data += [(500, f"Zaphod has words z@example.org. {far} ZAPHOD again", "", "")]
    data += [(501, "large plain Zaphod, z@example.org table", "", "")]
    data += [(502, "the table of zaphod alone", "", "")]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(data[:-1], SCHEMA)).collect()}
    texts = {d: t for d, t, *_ in data}

    def terms(i):
        spans = [s.split(":") for s in got[i].spans.split(",") if s.startswith("term")]
        return [texts[i][int(a) : int(b)] for _, a, b in spans]

    assert terms(500).count("Zaphod") == terms(500).count("ZAPHOD") == 1 and terms(501) == ["Zaphod"]
    # where the entity is not written: one text of six has the term without it
    data += [(600 + i, f"Zaphod wrote {'abcd'[i]}{'efgh'[i]}x to z@example.org", "", "") for i in range(4)]
    texts = {d: t for d, t, *_ in data}
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(data, SCHEMA)).collect()}
    assert terms(502) == ["zaphod"] and not any(terms(i) for i in range(400))
