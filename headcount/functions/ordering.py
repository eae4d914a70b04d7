"""Exact order statistics without a window over the whole table.

A rank, a quantile or a row position needs every smaller row counted. The
functions here cut the order into ranges of about equal numbers of distinct
keys, count inside each range, and add what lies in the ranges before. A group
that holds most of the table spreads over as many ranges as its keys need, and
copies of one key are added up before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Keys sampled per range: enough that ranges differ little in size.
OVERSAMPLE = 16
# Rows per block of a sliding window.
BLOCK_ROWS = 100_000
# Hex digits of the hash that make one bucket when the smallest hashes are sought, and
# how often the bucket with the border is cut again before its rows are sorted.
PREFIX_DIGITS = 4
PREFIX_ROUNDS = 2
# Keys per range, from which the number of ranges follows, and that number at most: the
# cut points are one array, held by every task.
RANGE_KEYS = 2_000_000
MOST_RANGES = 65_536


def _present(df: DataFrame, columns: list[str]) -> DataFrame:
    # One test per column, as the optimizer writes them: all branches then read
    # through the same filter and can share a shuffle.
    for c in columns:
        df = df.where(F.col(c).isNotNull())
    return df


def _ranges(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _cut_points(df: DataFrame, key: Column, hashed: list[str], ranges: int) -> Column:
    """Ascending keys that split the keys into `ranges` parts, or more in a large table.

    The sample is every key whose row hash falls below a limit, so each run and
    each retried task sees the same cut points. Its size is about `OVERSAMPLE` per
    range, and the ranges follow from the number of rows.
    """
    share = (F.xxhash64(*hashed).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    keys = df.select(key.alias("k"), share.alias("share"))
    rows = keys.agg(F.count_if(F.col("share") >= 0)).scalar()
    needed = F.least(F.ceil(rows / F.lit(RANGE_KEYS)), F.lit(MOST_RANGES))
    wanted = F.greatest(needed, F.lit(ranges)) * OVERSAMPLE
    sample = keys.where(F.col("share") <= wanted / F.greatest(rows, F.lit(1)))
    ordered = sample.agg(F.array_sort(F.collect_set("k")).alias("a"))
    every = F.filter("a", lambda _, i: i % OVERSAMPLE == OVERSAMPLE - 1)
    return ordered.select(every).scalar()


def _located(df: DataFrame, key: Column, cuts: Column) -> DataFrame:
    """Add `_range`, the number of cut points at or below `key`, by halving steps."""
    found = df.withColumn("_cuts", cuts)
    bits = F.sequence(F.length(F.bin(F.size("_cuts"))) - 1, F.lit(0), F.lit(-1))

    def halve(at: Column, bit: Column) -> Column:
        step = F.call_function("shiftleft", F.lit(1), bit)
        return at + F.when(F.get("_cuts", at + step - 1) <= key, step).otherwise(0)

    return found.withColumn("_range", F.aggregate(bits, F.lit(0), halve)).drop("_cuts")


def running_sum(
    df: DataFrame, by: list[str], order: list[str], weight: str, aggregated: bool = True
) -> DataFrame:
    """Add `before` and `total`: the weight sorted ahead of each row, and in all.

    Both are taken among the rows with the same `by` values. `order` must be
    unique within `by`, and none of the columns may be null. `aggregated` says
    that `df` comes straight out of a grouping: then every branch below is made to
    need all its columns, so that Spark runs its scan and shuffle once for all.
    Raw rows are scanned by each branch for just the columns it needs.
    """
    ranges = _ranges(df)
    names = [*by, *order]
    needed = df.columns if aggregated else names
    key = F.struct(*names) if len(names) > 1 else F.col(names[0])
    located = _located(df, key, _cut_points(df, key, needed, ranges))
    inner = W.partitionBy("_range", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    inside = located.withColumn("_inside", F.coalesce(F.sum(weight).over(inner), F.lit(0)))
    sums = (
        located.groupBy("_range", *by)
        .agg(F.sum(weight).alias("_sum"), F.max(F.xxhash64(*needed)).alias("_seen"))
        .where(F.col("_seen").isNotNull())
    )
    # At most one row per range for each `by`.
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    earlier = group.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        "_range",
        *by,
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_sum").over(group).alias("total"),
    )
    return (
        inside.join(offsets, ["_range", *by])
        .withColumn("before", F.col("_inside") + F.col("_offset"))
        .drop("_range", "_inside", "_offset")
    )


def row_positions(df: DataFrame, order: list[str], few_rows: bool = False) -> DataFrame:
    """Add `pos` (0, 1, ...) and `total`, the number of rows, in the given order.

    `order` must name a row uniquely. With `few_rows` the caller vouches for a
    table bounded by the calendar (one row per period), and a plain window does.
    """
    if few_rows:
        whole = W.partitionBy(F.lit(0))
        return df.withColumns(
            {
                "pos": (F.row_number().over(whole.orderBy(*order)) - 1).cast("bigint"),
                "total": F.count(F.lit(1)).over(whole),
            }
        )
    ranked = running_sum(df.withColumn("_one", F.lit(1)), [], order, "_one", aggregated=False)
    return ranked.withColumn("pos", F.col("before").cast("bigint")).drop("_one", "before")


def quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact, linearly interpolated quantiles of `value` per `by`; nulls left out.

    One row per `by`, one column per entry of `probs`. Equal values are counted
    before the shuffle, so the work grows with the distinct values.
    """
    counts = _present(df, [*by, value]).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_sum(counts, by, [value], "_n")
    upto = F.col("before") + F.col("_n")

    def at(rank: Column) -> Column:
        return F.min(F.when(upto > rank, F.col(value)))

    parts, result = [], []
    for name, p in probs.items():
        h = (F.col("total") - 1) * F.lit(float(p))
        parts += [
            at(F.floor(h)).alias(f"_{name}_lo"),
            at(F.ceil(h)).alias(f"_{name}_hi"),
            F.max(h - F.floor(h)).alias(f"_{name}_frac"),
        ]
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        result.append((low + (high - low) * F.col(f"_{name}_frac")).alias(name))
    return ranked.groupBy(*by).agg(*parts).select(*by, *result)


def average_ranks(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row per (value, group): `n` rows of it, `ties` rows of that value, `rank`.

    `rank` is the mean rank, from 1, of the rows that share the value. Rows are
    counted per value and group, values are ranked once, and the ranks go back to
    the counts; the same plan serves any number of groups.
    """
    present = _present(df, [value, group])
    counts = present.groupBy(F.col(value).alias("value"), F.col(group).alias("group")).agg(
        F.count(F.lit(1)).alias("n")
    )
    values = counts.groupBy("value").agg(F.sum("n").alias("ties"))
    rank = F.col("before") + (F.col("ties") + 1) / F.lit(2.0)
    ranked = running_sum(values, [], ["value"], "ties").select("value", "ties", rank.alias("rank"))
    return counts.join(ranked, "value").select("value", "ties", "rank", "group", "n")


def sliding(df: DataFrame, before: int, after: int, columns: dict, block: int = BLOCK_ROWS) -> DataFrame:
    """Aggregates over the rows `pos - before` to `pos + after`, in even blocks.

    `df` has `pos` from `row_positions`; `columns` maps a name to a function of
    the window. Rows near a block's edge are lent to the neighbouring block.
    """
    home = F.floor(F.col("pos") / F.lit(block))
    first = F.greatest(F.floor((F.col("pos") - after) / F.lit(block)), F.lit(0))
    last = F.floor((F.col("pos") + before) / F.lit(block))
    lent = df.withColumn("_block", F.explode(F.sequence(first, last)))
    window = W.partitionBy("_block").orderBy("pos").rowsBetween(-before, after)
    return (
        lent.withColumns({name: make(window) for name, make in columns.items()})
        .where(F.col("_block") == home)
        .drop("_block")
    )


def hash_order(key: str, seed: int) -> Column:
    """A shuffle order that is the same on every run and engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def smallest_by_hash(df: DataFrame, key: str, seed: int, by: list[str], wanted: DataFrame) -> DataFrame:
    """Per `by`, the last (hash, key) among the `wanted` first rows in hash order.

    `wanted` has one row per `by` with the number of rows in `k`; the result has
    one row per `by` with `last`, null where `k` is 0. Counting hash prefixes finds
    the one bucket in which the limit falls, and prefixes within it a smaller one; only
    the rows of the last, one in 2^32, are sorted.
    """
    inside = df.select(*by, F.col(key).alias("_key"), hash_order(key, seed).alias("_hash"))
    needs = wanted.select(*by, F.col("k").alias("_need"))
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    for done in range(PREFIX_ROUNDS):
        prefix = F.substring("_hash", 1 + done * PREFIX_DIGITS, PREFIX_DIGITS)
        inside = inside.drop("_need").withColumn("_prefix", prefix)
        upto = group.orderBy("_prefix").rowsBetween(W.unboundedPreceding, W.currentRow)
        counted = inside.groupBy(*by, "_prefix").agg(F.count(F.lit(1)).alias("_n"))
        reached = counted.withColumn("_upto", F.sum("_n").over(upto))
        if by:
            reached = reached.join(needs, by)
        else:
            reached = reached.withColumn("_need", needs.select("_need").scalar())
        before = F.col("_upto") - F.col("_n")
        border = reached.where((F.col("_upto") >= F.col("_need")) & (before < F.col("_need")))
        border = border.select(*by, "_prefix", (F.col("_need") - before).alias("_need"))
        # One row per `by`, so the bucket's rows are found by a broadcast join.
        inside = inside.join(F.broadcast(border), [*by, "_prefix"]).drop("_prefix")
        needs = border.drop("_prefix")
    copies = inside.groupBy(*by, "_need", "_hash", "_key").agg(F.count(F.lit(1)).alias("_n"))
    earlier = group.orderBy("_hash", "_key").rowsBetween(W.unboundedPreceding, -1)
    taken = copies.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    return (
        taken.where(F.col("_before") < F.col("_need"))
        .groupBy(*by)
        .agg(F.max(F.struct("_hash", "_key")).alias("last"))
    )
