"""The numbers behind histograms, densities, boxes, hierarchies and scatters."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headcount.functions.ordering import hash_order
from headcount.functions.shapes import stat, with_stats
from headcount.operators.quality import fences

# A normal kernel this many bandwidths away adds less than a double resolves next to
# any point within reach; a gap farther than this from all values reads 0.
KERNEL_REACH = 9.0


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Rows in equal bins from the smallest to the largest value, the last one closed.

    Every bin is listed, empty ones with 0.
    """
    value = df.select(F.col(f"`{column}`").cast("double").alias("x")).where("x is not null")
    extent = value.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi"))).scalar()
    lo = F.col("_extent")["lo"]
    width = (F.col("_extent")["hi"] - lo) / F.lit(float(bins))
    found = F.when(width > 0, F.floor((F.col("x") - lo) / width)).otherwise(F.lit(0))
    counts = (
        value.withColumn("_extent", extent)
        .groupBy(F.least(found, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").withColumn("_extent", extent).select(
        "bin",
        (lo + width * F.col("bin")).alias("start"),
        (lo + width * (F.col("bin") + 1)).alias("end"),
        F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("count"),
    )


def density(
    df: DataFrame, column: str, points: int = 200, reach: float = KERNEL_REACH
) -> DataFrame:
    """Normal-kernel density on an even grid from the smallest to the largest value.

    The bandwidth is the standard deviation times n^(-1/5). A value contributes
    only to grid points within `reach` bandwidths, and contributions are summed
    before the shuffle: no data row is shuffled, and at most `points` sums are. Where
    all values are equal, or there is one, the density is null.
    """
    value = df.select(F.col(f"`{column}`").cast("double").alias("x")).where("x is not null")
    moments = value.agg(
        F.struct(
            F.min("x").alias("lo"),
            F.max("x").alias("hi"),
            F.stddev_samp("x").alias("sd"),
            F.count("x").cast("double").alias("n"),
        )
    ).scalar()
    m = F.col("_moments")
    step = (m["hi"] - m["lo"]) / F.lit(float(points - 1))
    width = m["sd"] * F.pow(m["n"], F.lit(-0.2))
    fixed = value.withColumn("_moments", moments).withColumns(
        {"lo": m["lo"], "step": step, "width": width}
    )
    reach = F.col("width") * F.lit(float(reach))
    first = F.greatest(F.floor((F.col("x") - reach - F.col("lo")) / F.col("step")), F.lit(0))
    last = F.least(F.ceil((F.col("x") + reach - F.col("lo")) / F.col("step")), F.lit(points - 1))
    near = fixed.where((F.col("step") > 0) & (F.col("width") > 0)).withColumn(
        "point", F.explode(F.sequence(first, last))
    )
    z = (F.col("lo") + F.col("point") * F.col("step") - F.col("x")) / F.col("width")
    sums = near.groupBy(F.col("point").cast("int").alias("point")).agg(
        F.sum(F.exp(z * z * F.lit(-0.5))).alias("s")
    )
    every = df.sparkSession.range(points).select(F.col("id").cast("int").alias("point"))
    scale = m["n"] * width * F.sqrt(F.lit(2.0) * F.pi())
    return every.join(sums, "point", "left").withColumn("_moments", moments).select(
        "point",
        (m["lo"] + step * F.col("point")).alias("x"),
        F.try_divide(F.coalesce(F.col("s"), F.lit(0.0)), scale).alias("density"),
    )


def rug(df: DataFrame, column: str) -> DataFrame:
    """The raw non-null values drawn under a density."""
    return df.select(F.col(f"`{column}`").alias("value")).where("value is not null")


def box_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: quartiles, fences, whiskers (extremes inside the fences), outliers."""
    fields = ["q1", "median", "q3", "lower", "upper"]
    known = with_stats(df, fences(df, columns, {"median": 0.5}), columns, fields)
    measures = []
    for i, c in enumerate(columns):
        value = F.col(f"`{c}`").cast("double")
        inside = value.between(stat(c, "lower"), stat(c, "upper"))
        measures += [
            F.min(F.when(inside, value)).alias(f"_{i}_low"),
            F.max(F.when(inside, value)).alias(f"_{i}_high"),
            F.count_if(~inside).alias(f"_{i}_out"),
        ]
    reached = known.agg(F.first("_stats").alias("_stats"), *measures)
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            *[stat(c, f).alias(f) for f in fields],
            F.col(f"_{i}_low").alias("whisker_low"),
            F.col(f"_{i}_high").alias("whisker_high"),
            F.col(f"_{i}_out").alias("outliers"),
        )
        for i, c in enumerate(columns)
    ]
    return reached.select(F.inline(F.array(*rows)))


def hierarchy_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of the inner ring (`a`, level 1) and the outer ring (`a`, `b`, level 2)."""
    return (
        df.dropna(subset=[a, b])
        .rollup(a, b)
        .agg(F.count(F.lit(1)).alias("count"), F.grouping_id().alias("g"))
        .where(F.col("g") < 3)
        .select(a, b, F.when(F.col("g") == 0, 2).otherwise(1).alias("level"), "count")
    )


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of each pair over the rows that have both values, long form."""
    pairs = list(combinations_with_replacement(columns, 2))

    def numeric(name: str) -> Column:
        return F.col(f"`{name}`").cast("double")

    wide = df.agg(
        *[F.corr(numeric(a), numeric(b)).alias(f"_{i}") for i, (a, b) in enumerate(pairs)]
    )
    cells = []
    for i, (a, b) in enumerate(pairs):
        cells.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("corr")))
        if a != b:
            cells.append(F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), F.col(f"_{i}").alias("corr")))
    return wide.select(F.inline(F.array(*cells)))


def scatter_sample(df: DataFrame, columns: list[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """`n` rows for a scatter matrix, the first in hash order of the key."""
    return (
        df.select(key, *columns)
        .orderBy(hash_order(key, seed), key)
        .limit(n)
    )


def scatter_points(df: DataFrame, columns: list[str]) -> DataFrame:
    """All rows for a scatter matrix."""
    return df.select(*columns)
