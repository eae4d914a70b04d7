"""Jump consistent hashing against a plain loop, and the numbering of slots."""

from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from headcount.llm import sharding

SCHEMA = "doc_id long, text string, shard string"


def plain_jump(key: int, shards: int) -> int:
    at, jump = -1, 0
    key %= 1 << 64
    while jump < shards:
        at = jump
        key = (key * sharding.MULTIPLIER + 1) % (1 << 64)
        jump = int((at + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return at


@pytest.mark.parametrize("shards", [1, 2, 24, 57, 666, 5000])
def test_jump_equals_plain_loop(spark, shards):
    keys = [0, 1, 42, 256, 0xDEAD10CC, -1, -(1 << 63), (1 << 63) - 1, *range(1000, 1100)]
    frame = spark.createDataFrame([(k,) for k in keys], "k long")
    got = frame.select("k", sharding.jump_hash(F.col("k"), shards).alias("s")).collect()
    assert {r.k: r.s for r in got} == {k: plain_jump(k, shards) for k in keys}


def test_published_values(spark):
    frame = spark.createDataFrame([(42,)], "k long")
    assert frame.select(sharding.jump_hash(F.col("k"), 57)).first()[0] == 43


def listing(spark, rows, shards=24):
    return sharding.shard_listing(spark.createDataFrame(rows, SCHEMA), shards).collect()


def test_listing(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 7)
    rows = [(i, f"téxt {i}", "clash") for i in range(600)]
    rows += [(7, "again", "clash")] * 300 + [(None, None, None), (None, "", None), (5, "x" * 300_000, "")]
    got = listing(spark, rows)
    assert len(got) == len(rows)
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(
            range(sum(r.shard == shard for r in got))
        )
    text = {(r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows}
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == text
    assert all(r.law == "key" and r.grown_shard in (r.shard, 24) for r in got)
    assert 0 < sum(r.grown_shard == 24 for r in got) < 150
    more = {r.doc_id: r.shard for r in listing(spark, rows, 25)}
    assert all(more[r.doc_id] == r.grown_shard for r in got)


def test_empty(spark):
    assert listing(spark, []) == []


def test_added_column_replaces(spark):
    frame = spark.createDataFrame([(1, "a", "old"), (None, None, None)], SCHEMA)
    got = sharding.with_shard(frame, "doc_id", 4)
    assert got.columns == ["doc_id", "text", "shard"]
    assert all(0 <= r.shard < 4 for r in got.collect())
