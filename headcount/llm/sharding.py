"""Sharding by jump consistent hashing, without a table of the ring.

A key jumps from shard to ever higher shards at points drawn from its own random
sequence; its shard is the last one below the number of shards. One more shard can
only add a jump to that shard, so appending moves the least fraction and nothing
else. Everything here is a column expression: no shuffle to assign, one to number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value of the published linear congruential step.
MULTIPLIER = 2862933555777941757

#: Rows of a (shard, block) that one task numbers.
BLOCK_ROWS = 50_000

#: Holds any unsigned 64-bit number.
DECIMAL = "decimal(20,0)"


def jump_path(key: Column, shards: int) -> Column:
    """(last, before): the shard among `shards + 1`, and that among `shards`.

    `key` is a long, read as unsigned. The state advances in decimals, which hold
    the 126-bit product exactly where a long would overflow. A key makes at most
    as many jumps as there are shards, and about their logarithm on average; the
    bound for many shards is so far in the tail that passing it is an error.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    most = shards + 1 if shards < 64 else 64 + 16 * math.ceil(math.log(shards))
    word = F.lit(str(1 << 64)).cast(DECIMAL)
    multiplier = F.lit(str(MULTIPLIER)).cast("decimal(19,0)")
    seed = F.when(key < 0, key.cast(DECIMAL) + word).otherwise(key.cast(DECIMAL))
    zero = F.lit(0).cast("long")
    state = F.struct(
        zero.alias("before"), zero.alias("last"), zero.alias("next"), seed.cast(DECIMAL).alias("seed")
    )

    def leap(at: Column, _: Column) -> Column:
        seed = ((at["seed"] * multiplier + F.lit(1)) % word).cast(DECIMAL)
        draw = F.floor(seed / F.lit(1 << 33)).cast("double") + 1.0
        return F.when(
            at["next"] <= shards,
            F.struct(
                F.when(at["next"] < shards, at["next"]).otherwise(at["before"]).alias("before"),
                at["next"].alias("last"),
                F.floor((at["next"] + 1) * (F.lit(float(1 << 31)) / draw)).alias("next"),
                seed.alias("seed"),
            ),
        ).otherwise(at)

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(most)),
        state,
        leap,
        lambda at: F.when(at["next"] > shards, at).otherwise(
            F.raise_error(F.lit("a key did not come to rest"))
        ),
    )


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, from 0, of a long key among `shards`."""
    return jump_path(F.coalesce(key.cast("long"), F.lit(0)), shards)["before"].cast("int")


def row_key(column: Column) -> Column:
    """A well mixed long of any column; null has a key of its own."""
    return F.xxhash64(column)


def with_shard(
    df: DataFrame, key: str = "doc_id", shards: int = 24, name: str = "shard"
) -> DataFrame:
    """Add the shard of each row; a column of that name is replaced. No shuffle."""
    return df.withColumn(name, jump_hash(row_key(F.col(key)), shards))


def shard_listing(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Every row of `docs` with its shard, its place there and its shard after growth.

    Columns: doc_id, size (UTF-8 bytes of the text plus 8; null text: 8), text_crc32
    (null text: that of no bytes, 0), law ("key"), shard, slot (from 0 without gaps in
    each shard), grown_shard (with one more shard). Rows with a null doc_id share one
    key. Rows equal in doc_id, size and checksum are counted before the shuffle and
    numbered together, so a row repeated without end is no large group. Other columns
    of `docs` are not read. An empty table gives no rows.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    blocks = math.ceil(docs.count() / (shards * BLOCK_ROWS)) or 1
    key = ["doc_id", "size", "text_crc32"]
    path = jump_path(row_key(F.col("doc_id")), shards)
    counted = (
        rows.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("path", path)
        .select(
            *key,
            "n",
            F.col("path.before").cast("int").alias("shard"),
            F.when(F.col("path.last") <= shards, F.col("path.last"))
            .cast("int")
            .alias("grown_shard"),
            F.pmod(F.xxhash64(*key), F.lit(blocks)).alias("block"),
        )
    )
    within = Window.partitionBy("shard", "block").orderBy(*key)
    placed = counted.withColumn(
        "start",
        F.coalesce(
            F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ),
    )
    before = Window.partitionBy("shard").orderBy("block")
    offsets = (
        counted.groupBy("shard", "block")
        .agg(F.sum("n").alias("rows"))
        .select(
            "shard",
            "block",
            F.coalesce(
                F.sum("rows").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("offset"),
        )
    )
    return (
        placed.join(offsets, ["shard", "block"])
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        .select(
            *key,
            F.lit("key").alias("law"),
            "shard",
            (F.col("offset") + F.col("start") + F.col("copy")).alias("slot"),
            "grown_shard",
        )
    )
