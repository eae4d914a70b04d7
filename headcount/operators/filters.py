"""Row filters of the attrition view, and their options and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALL = "All"


def exited_only(df: DataFrame, left: str = "DOE") -> DataFrame:
    return df.where(F.col(left).isNotNull())


def quick_filter(
    df: DataFrame,
    year: int | None = None,
    month_name: str | None = None,
    year_column: str = "Exit_Year",
    month_column: str = "Exit_Month",
) -> DataFrame:
    """Equality on year and month name; None keeps all (a month alone spans all years)."""
    if year is not None:
        df = df.where(F.col(year_column) == year)
    if month_name is not None:
        df = df.where(F.col(month_column) == month_name)
    return df


def date_range_filter(
    df: DataFrame, column: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Dates from start to end, both included; an open end takes the column's own extent."""
    day = F.to_date(F.col(column))
    # Comparing with the column's own minimum or maximum keeps every non-null date.
    df = df.where(F.col(column).isNotNull())
    if start is not None:
        df = df.where(day >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(day <= F.lit(end).cast("date"))
    return df


def custom_period_filter(
    df: DataFrame,
    first_year: int,
    last_year: int,
    months: list[str],
    year_column: str = "Exit_Year",
    month_column: str = "Exit_Month",
) -> DataFrame:
    """Years first..last, both included, and only the named months."""
    return df.where(
        F.col(year_column).between(first_year, last_year) & F.col(month_column).isin(months)
    )


def member_filter(df: DataFrame, choices: dict[str, list]) -> DataFrame:
    """Keep rows whose value is among the choices of every column; "All" lifts a column."""
    for column, values in choices.items():
        if ALL not in values:
            df = df.where(F.col(f"`{column}`").isin(values))
    return df


def active_filters(choices: dict[str, list]) -> list[str]:
    return [column for column, values in choices.items() if ALL not in values]


def distinct_options(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values in ascending order (month names as text)."""
    return (
        df.select(F.col(f"`{column}`").alias("option"))
        .where(F.col("option").isNotNull())
        .distinct()
        .orderBy("option")
    )


def filter_summary(df: DataFrame, predicate) -> DataFrame:
    """One row: how many rows the predicate keeps, and how many there are."""
    return df.agg(
        F.count_if(F.coalesce(predicate, F.lit(False))).alias("kept"),
        F.count(F.lit(1)).alias("total"),
    )
