"""Profiles of whole tables and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headcount.functions.ordering import quantiles
from headcount.functions.shapes import melt
from headcount.operators.quality import modes

# The quantiles of a numeric description.
DESCRIBED = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def _long(wide: DataFrame, columns: list[str], fields: list[str]) -> DataFrame:
    """One row of `name__field` columns to one row per name."""
    rows = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}__{f}`").alias(f) for f in fields])
        for c in columns
    ]
    return wide.select(F.inline(F.array(*rows)))


def _measure(df: DataFrame, columns: list[str], measures: dict) -> DataFrame:
    """Aggregates of several columns in one pass; `measures` maps a field to a function."""
    wide = df.agg(
        *[make(F.col(f"`{c}`"), c).alias(f"{c}__{f}") for c in columns for f, make in measures.items()]
    )
    return _long(wide, columns, list(measures))


def overview(df: DataFrame) -> DataFrame:
    """One row: rows, columns, and null cells in all."""
    cells = F.lit(0)
    for c in df.columns:
        cells = cells + F.when(F.col(f"`{c}`").isNull(), 1).otherwise(0)
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(cells), F.lit(0)).alias("missing")
    ).select("rows", F.lit(len(df.columns)).alias("columns"), "missing")


def column_profile(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """Per column: type, number of distinct non-null values, number of nulls.

    The exact count adds up equal values of all columns in one narrow shuffle;
    the approximate one shuffles a sketch per column. Zero is one value, whatever
    its sign.
    """
    columns = columns or df.columns
    df = df.withColumns(
        {c: F.col(f"`{c}`") + F.lit(0.0) for c in columns if df.schema[c].dataType.typeName() == "double"}
    )
    types = F.create_map(
        *[F.lit(x) for c in columns for x in (c, df.schema[c].dataType.simpleString())]
    )
    if approximate:
        found = _measure(
            df,
            columns,
            {
                "distinct": lambda c, _: F.approx_count_distinct(c),
                "nulls": lambda c, _: F.count(F.lit(1)) - F.count(c),
            },
        )
    else:
        present = F.col("value").isNotNull()
        counts = melt(df, columns, "string").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        found = counts.groupBy("column").agg(
            F.count_if(present).alias("distinct"),
            F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("nulls"),
        )
    return found.select("column", types[F.col("column")].alias("type"), "distinct", "nulls")


def _moments(df: DataFrame, columns: list[str], more: dict | None = None) -> DataFrame:
    return _measure(
        df,
        columns,
        {
            "count": lambda c, _: F.count(c),
            "mean": lambda c, _: F.avg(c),
            "std": lambda c, _: F.stddev_samp(c),
            "min": lambda c, _: F.min(c).cast("double"),
            "max": lambda c, _: F.max(c).cast("double"),
        }
        | (more or {}),
    )


def describe_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: count, mean, standard deviation (n-1), extremes and exact quartiles."""
    parts = quantiles(melt(df, columns, "double"), ["column"], "value", DESCRIBED)
    # Both sides have one row per column.
    return _moments(df, columns).join(parts, "column", "left").select(
        "column", "count", "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def describe_dates(df: DataFrame, columns: list[str]) -> DataFrame:
    """The same for date columns, in timestamps; there is no standard deviation."""
    seconds = df.select(
        [F.unix_seconds(F.col(f"`{c}`").cast("timestamp")).cast("double").alias(c) for c in columns]
    )
    described = describe_numeric(seconds, columns)
    return described.select(
        "column",
        "count",
        *[
            F.timestamp_seconds(F.floor(f)).cast("timestamp_ntz").alias(f)
            for f in ("mean", "min", "q25", "q50", "q75", "max")
        ],
    )


def describe_categorical(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per string column: count, distinct values, most frequent value and its count.

    Values are counted once; every figure follows from those counts.
    """
    counts = (
        melt(df, columns, "string")
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    present = F.col("value").isNotNull()
    best = F.min(F.when(present, F.struct((-F.col("n")).alias("fewer"), F.col("value")))).alias("best")
    return (
        counts.groupBy("column")
        .agg(
            F.coalesce(F.sum(F.when(present, F.col("n"))), F.lit(0)).alias("count"),
            F.count_if(present).alias("unique"),
            best,
        )
        .select(
            "column",
            "count",
            "unique",
            F.col("best.value").alias("top"),
            (-F.col("best.fewer")).alias("freq"),
        )
    )


def categorical_modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per string column: the most common value and how often it occurs."""
    return modes(df, columns).select("column", F.col("mode").alias("most_common"), F.col("freq").alias("frequency"))


def _skew(population: Column, n: Column) -> Column:
    """Sample skewness from the population figure; needs three values."""
    return F.when(n > 2, population * F.sqrt(n * (n - 1)) / (n - 2))


def _kurt(population: Column, n: Column) -> Column:
    """Sample excess kurtosis from the population figure; needs four values."""
    return F.when(n > 3, ((n + 1) * population + 6) * (n - 1) / ((n - 2) * (n - 3)))


def describe_extended(df: DataFrame, columns: list[str]) -> DataFrame:
    """`describe_numeric` with bias-corrected skewness and excess kurtosis."""
    parts = quantiles(melt(df, columns, "double"), ["column"], "value", DESCRIBED)
    more = {
        "skewness": lambda c, _: _skew(F.skewness(c), F.count(c).cast("double")),
        "kurtosis": lambda c, _: _kurt(F.kurtosis(c), F.count(c).cast("double")),
    }
    return _moments(df, columns, more).join(parts, "column", "left").select(
        "column", "count", "mean", "std", "min", "q25", "q50", "q75", "max", "skewness", "kurtosis"
    )
