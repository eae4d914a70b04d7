"""The pipeline against a brute-force version on a small corpus."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from headcount.llm import mixing, quality
from tests.llm.test_sharding import plain_jump
from tests.llm.test_simhash import plain_groups, plain_print

SF = "/root/testdata/sf0.001"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_against_brute_force(spark):
    docs = table(spark, "documents")
    graded = quality.graded(docs, table(spark, "labels")).where("keep").collect()
    prints = {r.doc_id: plain_print(r.text) for r in graded}
    group = plain_groups(prints.values())
    first = {}
    for d, f in prints.items():
        first[group[f]] = min(d, first.get(group[f], d))
    rows = {r.doc_id: r for r in graded if r.doc_id in set(first.values())}

    def windows(text):
        words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    items = [windows(r.text) for r in table(spark, "benchmark").collect()]
    held = {d: windows(r.text) for d, r in rows.items()}
    rows = {d: r for d, r in rows.items() if not any(2 * len(i & held[d]) >= len(i) for i in items)}
    kept = spark.createDataFrame([tuple(r)[: len(docs.columns)] for r in rows.values()], docs.schema)
    copies = {r.doc_id: r.copies for r in mixing.draw(kept, identity=docs.columns).collect()}
    want = Counter({d: n for d, n in copies.items() if n})
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == [*docs.columns, "shard"]
    got = got.collect()
    assert Counter(r.doc_id for r in got) == want
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text == text[r.doc_id] and 0 <= r.shard < 24 for r in got)


def test_stages_on_odd_rows(spark, tmp_path):
    """Every stage takes nulls, empty texts, repeated rows and an empty table."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard string, keep string"
    rows = [(None, None, None, None, None, None, None), (1, "", "en", "", 0, "s", "k"), (1, "", "en", "", 0, "s", "k")]
    rows += [(i, f"some plain words number {i} in a row " * 5, "en", "a", 1, "s", "k") for i in range(2, 9)]
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for name, stage in corpus_pipeline.STAGES:
            kept = stage(spark, docs, SF)
            assert kept.columns == docs.columns, name
            assert {tuple(r)[:5] for r in kept.collect()} <= {r[:5] for r in some}, name


def test_shards_are_those_of_the_plain_loop(spark):
    from headcount.llm import sharding
    from pyspark.sql import functions as F

    keys = spark.range(50).select("id", sharding.row_key(F.col("id")).alias("k"), sharding.jump_hash(sharding.row_key(F.col("id")), 24).alias("s"))
    assert all(r.s == plain_jump(r.k, 24) for r in keys.collect())
