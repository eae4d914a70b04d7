"""The corpus pipeline: grade, drop near-duplicates and leaks, mix, and shard.

Each stage takes the documents its predecessor kept and is written as Parquet below
the shared folder, so a lost executor costs at most one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headcount.llm import decontaminate, mixing, quality, sharding, simhash
from headcount.session import Scratch

SHARDS = 24


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps, by the labels of the corpus."""
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    graded = quality.graded(rows, _table(spark, sf_dir, "labels"))
    return graded.where("keep").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, three words a shingle and two bits."""
    return simhash.keep_one(docs, words=3, bits=2)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 5, 2, 1 and 150 % of the words; documents repeat as drawn."""
    spare = tuple(f"{n}_{'_'.join(docs.columns)}" for n in ("shard", "key"))
    return mixing.mixture(docs, weights=(5, 2, 1), share=1.5, most=2.0, names=spare).select(
        *docs.columns
    )


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard of each document by jump consistent hashing of its doc_id."""
    return sharding.with_shard(docs, "doc_id", SHARDS, "shard")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", drop_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources to target weights", mix_sources),
    ("sharding", assign_shards),
]

#: SQL cannot fit the classifier; tests compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs, path = _table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs, written = scratch.keep(stage(spark, docs, sf_dir))
        scratch.drop(path)
        path = written
    return docs
