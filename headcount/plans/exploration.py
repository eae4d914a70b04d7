"""Time-series exploration: aggregate, smooth, fit, decompose."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headcount.operators import timeseries


@dataclass(frozen=True)
class Series:
    """The processed series and what is drawn and listed beside it."""

    values: DataFrame
    trend: DataFrame
    parts: DataFrame
    summary: DataFrame


def time_series(
    df: DataFrame, date: str, value: str, grain: str = "none", smoothing: int = 0, key: str | None = None
) -> Series:
    """Aggregate by the grain, smooth over rows, then fit a line and decompose.

    Without aggregation the rows are ordered by date and `key`, which must tell
    rows of one date apart.
    """
    few = grain != "none"
    if few:
        values, order = timeseries.resample_mean(df, date, value, grain), ["period"]
    else:
        if key is None:
            raise ValueError("a series of raw rows needs a key to order rows of one date")
        values = df.where(F.col(date).isNotNull()).select(
            F.col(date).alias("period"), F.col(key).alias("key"), F.col(value).alias("value")
        )
        order = ["period", "key"]
    if smoothing > 0:
        smoothed = timeseries.moving_average(values, order, "value", smoothing, few)
        values = smoothed.select(*order, F.col("smoothed").alias("value"))
    return Series(
        values,
        timeseries.linear_trend(values, order, "value", few),
        timeseries.seasonal_decompose(values, order, "value", grain, few),
        timeseries.trend_summary(values, order, "value", few),
    )
