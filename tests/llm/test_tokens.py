"""Rollups against counting everything anew."""

from __future__ import annotations

from collections import Counter

import pytest

from headcount.llm import queries, tokens
from headcount.session import shared_path

DOCS = "doc_id long, text string, lang string, source string, n_tokens string, tokenizer string"
SF = "/root/testdata/sf0.001"


def rows():
    out = [(i, f"text number {i} " * (i % 7), "en" if i % 3 else None, f"s{i % 4}") for i in range(60)]
    out += [(1, "text", "en", None), (None, None, "de", "s1"), (61, "", "de", "s1"), (62, "a" * 100_000, "de", "s2")]
    out += [(63, "word " * 100_000, "de", "s2"), (64, "<|endoftext|> é\x00", "de", "s2")] * 2
    return [(*r, "clash", "clash") for r in out]


def plain(data):
    with open(tokens.VOCABULARY, "rb") as file:
        encoding = tokens._encoding(file.read(), tokens.PATTERN)
    totals = Counter()
    for _, text, lang, source, *_ in data:
        text = text or ""
        for name, n in (("docs", 1), ("tokens", len(encoding.encode_ordinary(text))), ("bytes", len(text.encode()))):
            totals[source, lang, name] += n
    return totals


def as_counter(frame):
    totals = Counter()
    for r in frame.collect():
        assert r.tokenizer == tokens.version()
        for name in ("docs", "tokens", "bytes"):
            totals[r.source, r.lang, name] += r[f"n_{name}"]
    return totals


@pytest.fixture
def rollup(spark):
    return tokens.Rollup(spark, shared_path(spark, "rollup-test"))


def test_inserts_deletes_revisions(spark, rollup):
    data = rows()
    facts = tokens.counted(spark.createDataFrame(data, DOCS))
    guess = tokens.estimated(spark.createDataFrame(data, DOCS))
    gone = tokens.counted(spark.createDataFrame(data[:20], DOCS))
    assert rollup.totals().collect() == []
    assert rollup.commit("a", tokens.signed(guess, 1))
    assert not rollup.commit("a", tokens.signed(guess, 1))
    assert rollup.commit("b", tokens.revised(guess, facts))
    assert +as_counter(rollup.totals()) == +plain(data)
    rollup.compact()
    assert not rollup.commit("b", tokens.revised(guess, facts))
    assert rollup.commit("c", tokens.signed(gone, -1))
    assert +as_counter(rollup.totals()) == +plain(data[20:])
    rollup.compact()
    assert +as_counter(rollup.totals()) == +plain(data[20:])
    assert rollup.commit("d", tokens.signed(tokens.counted(spark.createDataFrame(data[20:], DOCS)), -1))
    assert rollup.totals().collect() == []


def test_a_batch_that_died_has_not_happened(spark, rollup):
    frame = spark.createDataFrame(rows(), DOCS)

    class Lost(Exception):
        pass

    def lose(*_):
        raise Lost

    rollup._create, kept = lose, rollup._create
    with pytest.raises(Lost):
        rollup.commit("a", tokens.signed(tokens.counted(frame), 1))
    rollup._create = kept
    assert rollup.totals().collect() == []
    assert rollup.commit("a", tokens.signed(tokens.counted(frame), 1))
    assert +as_counter(rollup.totals()) == +plain(rows())


def test_empty_batch(spark, rollup):
    empty = spark.createDataFrame([], DOCS)
    assert rollup.commit("a", tokens.signed(tokens.counted(empty), 1))
    assert rollup.totals().collect() == []
    with pytest.raises(ValueError):
        rollup.commit("a/b", tokens.signed(tokens.counted(empty), 1))


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    assert +as_counter(queries.op4_token_counts(spark, SF)) == +plain(docs)
