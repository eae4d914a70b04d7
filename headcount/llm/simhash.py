"""Near-duplicates by SimHash fingerprints and multi-index hashing.

A fingerprint is the bitwise majority of the hashes of a text's word shingles. Two
fingerprints at most two bits apart are linked. Cut in two segments, such a pair
either is within one bit in the high segment or agrees in the low one, so each
fingerprint looks up its one-bit ball in the table of high segments and itself in
the table of low segments, and whole distances are verified.

A segment shared by very many fingerprints would give a square of candidates. Those
fingerprints go through the ball of the whole word instead: two of them are at most
two bits apart exactly if their one-bit balls meet, so the rows stay 65 per
fingerprint and members of a meeting point are linked to the smallest. Both ways
are exact, and together they give every link's component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headcount.llm.components import components
from headcount.session import Scratch

#: The seed of the shingle hash is a fixed value.
SEED = 42
#: Shingles hashed at a time, which bounds memory for a very long text.
CHUNK = 1 << 16
#: Fingerprints with one segment value beyond which the whole-word ball is used.
CROWD = 64

LOW = 0xFFFFFFFF


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit fingerprint, as a signed long; 0 for null or a text without words."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    shingles = max(1, len(tokens) - words + 1)
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, shingles, CHUNK):
        stop = min(start + CHUNK, shingles)
        hashes = np.fromiter(
            (
                xxhash.xxh64_intdigest(b" ".join(tokens[i : i + words]), SEED)
                for i in range(start, stop)
            ),
            dtype="<u8",
            count=stop - start,
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > shingles, bitorder="little").view("<i8")[0])


def with_fingerprint(df: DataFrame, name: str = "fp", words: int = 3) -> DataFrame:
    """Add the fingerprint of the column `text` as a long; a column of that name is replaced."""

    @F.pandas_udf("long")
    def prints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprint(t, words) for t in batch], dtype="int64")

    return df.withColumn(name, prints(F.col("text")))


def _ball(name: str, width: int) -> Column:
    """The values at most one bit from a column, itself first."""
    one = F.lit(1).cast("long")
    flips = F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda i: F.col(name).bitwiseXOR(F.call_function("shiftleft", one, i)),
    )
    return F.concat(F.array(F.col(name)), flips)


def links(prints: DataFrame, scratch: Scratch, bits: int = 2) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints of column `fp` at distance <= `bits`.

    Every pair within the distance is in one component of the result, and every
    link is within it, except that members of a crowd may be tied to the smallest
    fingerprint of a shared ball, which lies within it too.
    """
    if bits != 2:
        raise ValueError("the segment radii are worked out for two bits")
    words = prints.select(
        "fp",
        F.shiftrightunsigned("fp", 32).alias("high"),
        F.col("fp").bitwiseAND(F.lit(LOW)).alias("low"),
    )
    rows = words.select("fp", F.col("high").alias("key"), F.lit(0).alias("part")).union(
        words.select("fp", F.col("low"), F.lit(1))
    )
    sizes = rows.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    probes = words.select(
        "fp", F.explode(_ball("high", 32)).alias("key"), F.lit(0).alias("part")
    ).union(words.select("fp", F.col("low"), F.lit(1)))
    # most values belong to one fingerprint: those in no crowd meet directly
    few = (
        rows.join(sizes.where(F.col("n") > CROWD), ["part", "key"], "left_anti")
        .withColumnRenamed("fp", "other")
    )
    direct = (
        probes.join(few, ["part", "key"])
        .where(F.col("fp") != F.col("other"))
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= bits)
        .select(F.col("fp").alias("a"), F.col("other").alias("b"))
    )
    crowds, crowd_path = scratch.keep(sizes.where(F.col("n") > CROWD).select("part", "key"))
    if crowds.isEmpty():
        scratch.drop(crowd_path)
        return direct
    crowded = probes.join(crowds, ["part", "key"], "left_semi").select("fp").distinct()
    met = crowded.select("fp", F.explode(_ball("fp", 64)).alias("point"))
    least = F.min("fp").over(Window.partitionBy("point"))
    return direct.union(
        met.withColumn("least", least)
        .where(F.col("fp") != F.col("least"))
        .select(F.col("fp").alias("a"), F.col("least").alias("b"))
    )


def groups(prints: DataFrame, scratch: Scratch, bits: int = 2) -> DataFrame:
    """(fp, root) for each distinct fingerprint: the smallest one reachable."""
    distinct, _ = scratch.keep(prints.select("fp").distinct())
    tied = components(links(distinct, scratch, bits), scratch)
    return distinct.join(tied.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root")
    )


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 2) -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint, component_id, root.

    component_id is the smallest doc_id that links reach, the row's own included;
    null doc_ids are passed over, and a component of none but these has null. Null
    and empty texts have fingerprint zero and are linked like any other. Repeated
    rows stay repeated. Only doc_id and text are read. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints, _ = scratch.keep(with_fingerprint(source, "fp", words).select("doc_id", "fp"))
    roots, _ = scratch.keep(groups(prints, scratch, bits))
    smallest = prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    component = (
        smallest.join(roots, "fp").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    )
    named, _ = scratch.keep(roots.join(component, "root").select("fp", "root", "component_id"))
    return prints.join(named, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        "root",
    )


def keep_one(docs: DataFrame, words: int = 3, bits: int = 2) -> DataFrame:
    """One row of each component: that with the smallest doc_id, nulls last.

    Among rows with that doc_id, the first in the order of their columns stays.
    """
    scratch = Scratch(docs.sparkSession, "simhash-keep")
    names = docs.columns
    source = docs.select(F.struct(*names).alias("row")).select(
        "row", F.col("row.text").alias("text"), F.col("row.doc_id").alias("doc_id")
    )
    prints, _ = scratch.keep(with_fingerprint(source, "fp", words).select("doc_id", "fp", "row"))
    roots, _ = scratch.keep(groups(prints, scratch, bits))
    smallest = prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    chosen = smallest.join(roots, "fp").groupBy("root").agg(F.min("doc_id").alias("first"))
    # the fingerprint that holds the chosen document stands for its component
    holder = (
        smallest.join(roots, "fp")
        .join(chosen, "root")
        .where(F.col("doc_id").eqNullSafe(F.col("first")))
        .groupBy("root", "first")
        .agg(F.min("fp").alias("fp"))
        .select("fp", "first")
    )
    return (
        prints.join(holder, "fp")
        .where(F.col("doc_id").eqNullSafe(F.col("first")))
        .groupBy("fp")
        .agg(F.min("row").alias("row"))
        .select("row.*")
    )
