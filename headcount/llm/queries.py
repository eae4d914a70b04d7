"""Registered queries of the corpus operators, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headcount.llm import (
    ann,
    decontaminate,
    html,
    mixing,
    pii,
    quality,
    secrets,
    sharding,
    simhash,
    spelling,
    suffixes,
    tokens,
    whitening,
)
from headcount.session import shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or with other slot values."""
    found = decontaminate.leaks(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.select("doc_id", "item_id", "windows", "of")


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes that repeat earlier strings of 100 bytes."""
    return suffixes.repeats(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents graded by the model fitted on the labelled ones."""
    found = quality.graded(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "expected_grade", "tail_probability", "keep")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after a batch of first figures for all documents and one of exact counts.

    Both batches are delivered twice, which changes nothing.
    """
    docs = table(spark, sf_dir, "documents")
    first, exact = tokens.estimated(docs), tokens.counted(docs)
    rollup = tokens.Rollup(spark, shared_path(spark, "token-counts"))
    for _ in range(2):
        rollup.commit("first-figures", tokens.signed(first, 1))
        rollup.commit("exact-counts", tokens.revised(first, exact))
    return rollup.totals()


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards by jump consistent hashing of doc_id."""
    return sharding.shard_listing(table(spark, sf_dir, "documents"), 24)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all documents and their components at two bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, bits=2)
    return found.select("doc_id", "fingerprint", "component_id")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed to 150 % of their words at weights 5, 2, 1."""
    found = mixing.draw(table(spark, sf_dir, "documents"), (5, 2, 1), share=1.5, most=2.0)
    return found.select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies", "shards"
    )


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all embeddings to every embedding whose id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return ann.nearest(rows, rows.where(F.col("vec_id") % 20 == 0), k=20)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents, and the terms that disclose it."""
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_term"
    )


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return html.extract(table(spark, sf_dir, "pages"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, and weak parts that complete a credential."""
    found = secrets.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the eight first components of their covariance, whitened."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=8)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of all documents that are long and frequent enough, and what they vary."""
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_suffixes": op2_suffixes,
    "op3_quality": op3_quality,
    "op4_token_counts": op4_token_counts,
    "op5_sharding": op5_sharding,
    "op6_simhash": op6_simhash,
    "op7_mixing": op7_mixing,
    "op8_neighbours": op8_neighbours,
    "op9_pii": op9_pii,
    "op10_html": op10_html,
    "op11_secrets": op11_secrets,
    "op12_whitening": op12_whitening,
    "op13_spelling": op13_spelling,
}

ORACLES: dict[str, str] = {}
