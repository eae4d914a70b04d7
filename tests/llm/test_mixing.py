"""Targets against plain water filling; quotas, draws and repeats of the mix."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from headcount.llm import mixing

SCHEMA = "doc_id long, text string, source string, target string, shards string"
WEIGHTS = (5, 2, 1)


def documents():
    draw = random.Random(3)
    rows = []
    for i in range(900):
        source = None if i % 50 == 7 else f"s{draw.choice([0, 0, 0, 0, 1, 2, 3, 4, 10, 11])}"
        rows.append((i, "w " * int(draw.paretovariate(1.2) * 5), source))
    rows += [(None, None, "s1"), (900, "", ""), (901, "a\x0bb c", ""), (902, "w " * 3000, "s0")]
    rows += [(5, "same row", "s3")] * 40
    return [(*r, "clash", "clash") for r in rows]


def plain_targets(size):
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, capped = 1.5 * sum(size.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        level = left / sum(weight[s] for s in free) if free else 0
        above = [s for s in free if weight[s] * level > 2 * size[s]]
        if not above:
            return capped | {s: weight[s] * level for s in free}
        for s in above:
            capped[s] = 2.0 * size[s]
            left -= capped[s]


@pytest.mark.parametrize("rows_per_block", [50_000, 20])
def test_targets_and_draws(spark, monkeypatch, rows_per_block):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", rows_per_block)
    rows = documents()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = mixing.draw(frame).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for _, text, source, _, _ in rows:
        size[source] += len((text or "").encode().split())
    want = plain_targets(size)
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source], rel=1e-9)
        assert r.source_size == size[r.source]
        assert r.taken == r.copies * r.size <= 2 * r.size and len(r.shards) == r.copies
        assert all(0 <= s < 16 for s in r.shards)
        taken[r.source] += r.taken
    for s, n in Counter(r[2] for r in rows).items():
        assert abs(taken[s] - want[s]) <= max(size[s] / n, 1)
    again = mixing.draw(frame.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_splitting_tree_keeps_quotas(spark):
    quotas = spark.createDataFrame([(0, 100), (1, 7), (2, 1), (3, 0)], "place int, quota long")
    got = {r.place: r.edges for r in mixing.splitting_tree(quotas, 5, 1).collect()}
    assert [got[p][-1] for p in range(4)] == [100, 7, 1, 0]
    per_shard = [sum(b - a for e in got.values() for a, b in [(e[i - 1] if i else 0, e[i])]) for i in range(5)]
    assert sum(per_shard) == 108 and max(per_shard) - min(per_shard) <= 2


def test_splitting_tree_law(spark):
    """Means over many seeds are those of drawing without replacement."""
    quotas = spark.createDataFrame([(0, 12), (1, 4)], "place int, quota long")
    first = [
        {r.place: r.edges[0] for r in mixing.splitting_tree(quotas, 2, seed).collect()}
        for seed in range(12)
    ]
    assert all(f[0] + f[1] == 8 for f in first)
    assert 5.2 < sum(f[0] for f in first) / 12 < 6.8 and len({f[1] for f in first}) > 1


def test_mixture_repeats_rows(spark):
    rows = documents()
    frame = spark.createDataFrame(rows, SCHEMA)
    plan = mixing.draw(frame, identity=frame.columns)
    want = plan.groupBy("doc_id", "source").agg(F.sum("copies").alias("n")).where("n > 0").collect()
    mixed = mixing.mixture(frame)
    assert mixed.columns == [*frame.columns, "shard", "shuffle_key"]
    got = mixed.groupBy("doc_id", "source").count().collect()
    assert {(r.doc_id, r.source): r["count"] for r in got} == {(r.doc_id, r.source): r.n for r in want}


def test_empty_and_wordless(spark):
    assert mixing.draw(spark.createDataFrame([], SCHEMA)).collect() == []
    assert mixing.mixture(spark.createDataFrame([], SCHEMA)).collect() == []
    got = mixing.draw(spark.createDataFrame([(1, "", "a", "", ""), (2, None, None, "", "")], SCHEMA)).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


def test_one_very_long_document(spark):
    """Documents are taken whole, so one that holds its source decides how near it comes."""
    rows = [(1, "w " * 200_000, "a", "", ""), (2, "w w", "a", "", ""), (3, "w", "b", "", "")]
    got = mixing.draw(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: r.copies for r in got} == {1: 1, 2: 2, 3: 2}
