"""Resampling, trend, smoothing and seasonal decomposition.

`few_rows=True` is for a series of one row per calendar period, as
`resample_mean` returns; a series of raw rows is positioned and windowed in
even blocks instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headcount.functions.ordering import row_positions, sliding
from headcount.session import cut_lineage

# Truncation unit and season length of each grain.
UNITS = {"daily": "day", "weekly": "week", "monthly": "month", "quarterly": "quarter", "yearly": "year"}
SEASONS = {"none": 7, "daily": 7, "weekly": 52, "monthly": 12, "quarterly": 4, "yearly": 1}


def resample_mean(df: DataFrame, date: str, value: str, grain: str) -> DataFrame:
    """Mean per period, labelled by its first day; weeks start on Monday.

    Null dates are left out and periods without rows are not listed.
    """
    period = F.to_date(F.date_trunc(UNITS[grain], F.col(date)))
    return (
        df.where(F.col(date).isNotNull())
        .groupBy(period.alias("period"))
        .agg(F.avg(value).alias("value"))
    )


def _line(positioned: DataFrame, value: str) -> Column:
    y, x = F.col(value), F.col("pos")
    return positioned.agg(
        F.struct(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    ).scalar()


def linear_trend(df: DataFrame, order: list[str], value: str, few_rows: bool = False) -> DataFrame:
    """Add the row position and the least-squares line over it.

    Raw rows are ordered once: the line and the result read the stored positions.
    """
    positioned = row_positions(df, order, few_rows).drop("total")
    if not few_rows:
        positioned = cut_lineage(positioned)
    line = F.col("_line")
    return (
        positioned.withColumn("_line", _line(positioned, value))
        .withColumn("fitted", line["intercept"] + line["slope"] * F.col("pos"))
        .drop("_line")
    )


def trend_summary(df: DataFrame, order: list[str], value: str, few_rows: bool = False) -> DataFrame:
    """One row: extent, mean, deviation, extremes, and the direction of the line.

    A flat line counts as Decreasing.
    """
    positioned = row_positions(df, order, few_rows)
    y = F.col(value)
    slope = F.regr_slope(y, F.col("pos"))
    rising = F.coalesce(slope > 0, F.lit(False))
    return positioned.agg(
        F.min(order[0]).alias("start"),
        F.max(order[0]).alias("end"),
        F.avg(y).alias("mean"),
        F.stddev_samp(y).alias("std"),
        F.min(y).alias("min"),
        F.max(y).alias("max"),
        F.when(rising, "Increasing").otherwise("Decreasing").alias("trend"),
    )


def moving_average(
    df: DataFrame, order: list[str], value: str, rows: int, few_rows: bool = False
) -> DataFrame:
    """Add the mean of the last `rows` rows, fewer at the start; 0 leaves the value as it is."""
    if rows <= 0:
        return df.withColumn("smoothed", F.col(value))
    positioned = row_positions(df, order, few_rows).drop("total")
    means = {"smoothed": lambda w: F.avg(value).over(w)}
    return sliding(positioned, rows - 1, 0, means).drop("pos")


def seasonal_decompose(
    df: DataFrame, order: list[str], value: str, grain: str = "none", few_rows: bool = False
) -> DataFrame:
    """Additive parts: observed, trend, seasonal, residual, in row order.

    The trend is the centred mean over one season (half weights at both ends
    when its length is even), null at the edges. Rows stand one step apart,
    whatever gaps the dates have. With fewer than two seasons all parts but the
    observed one are null. Raw rows are shuffled twice, to order them and to move the
    window; the season's means and the result read the stored trend.
    """
    period = SEASONS[grain]
    half = period // 2
    positioned = row_positions(df, order, few_rows)
    y = F.col(value)
    parts = {
        "_sum": lambda w: F.sum(y).over(w),
        "_rows": lambda w: F.count(y).over(w),
        "_first": lambda w: F.first(y).over(w),
        "_last": lambda w: F.last(y).over(w),
    }
    moved = sliding(positioned, half, half, parts)
    ends = (F.col("_first") + F.col("_last")) / 2 if period % 2 == 0 else F.lit(0.0)
    enough = F.col("total") >= 2 * period
    inner = enough & (F.col("_rows") == 2 * half + 1)
    trended = moved.withColumns(
        {"trend": F.when(inner, (F.col("_sum") - ends) / period), "_season": F.col("pos") % period}
    ).drop("_sum", "_rows", "_first", "_last")
    if not few_rows:
        trended = cut_lineage(trended)
    # One row per place in the season.
    means = (
        trended.groupBy("_season")
        .agg(F.avg(y - F.col("trend")).alias("_mean"))
        .where(F.col("_mean").isNotNull())
    )
    centre = means.agg(F.avg("_mean")).scalar()
    seasons = means.select("_season", (F.col("_mean") - centre).alias("seasonal"))
    return (
        trended.join(F.broadcast(seasons), "_season", "left")
        .withColumn("residual", y - F.col("trend") - F.col("seasonal"))
        .withColumn("observed", y)
        .select("pos", *order, "observed", "trend", "seasonal", "residual")
    )


def sort_by_date(df: DataFrame, date: str) -> DataFrame:
    return df.orderBy(date)
