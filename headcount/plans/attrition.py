"""The attrition view: prepare, clean, filter, count."""

from __future__ import annotations

from pyspark.sql import DataFrame

from headcount.functions.dates import exit_calendar
from headcount.operators.columns import with_attrition_measures
from headcount.operators.counts import attrition_breakdown
from headcount.operators.filters import (
    active_filters,
    custom_period_filter,
    date_range_filter,
    exited_only,
    member_filter,
    quick_filter,
)
from headcount.operators.quality import clean, handle_outliers
from headcount.session import cut_lineage


def prepare(
    df: DataFrame,
    as_of: str,
    exclude: tuple[str, ...] = ("DOE",),
    outlier_columns: list[str] | None = None,
    outliers: str = "None",
    store: bool = True,
) -> DataFrame:
    """Derive tenure and age, apply the null policy (not to the exit date), treat outliers.

    The result is stored, since the view reads it many times.
    """
    measured = with_attrition_measures(df, as_of)
    cleaned = clean(measured, [c for c in measured.columns if c not in exclude])
    if outliers == "Remove" and outlier_columns:
        # Each column's fences are a job of their own.
        cleaned = cut_lineage(cleaned)
    ready = handle_outliers(cleaned, outlier_columns or [], outliers)
    return cut_lineage(ready) if store else ready


def leavers(df: DataFrame) -> DataFrame:
    """Rows with an exit date, and the calendar of the exit."""
    return exit_calendar(exited_only(df))


def by_period(
    df: DataFrame,
    quick: tuple[int | None, str | None] | None = None,
    date_range: tuple[str | None, str | None] | None = None,
    custom: tuple[int, int, list[str]] | None = None,
) -> DataFrame:
    """One of the three time filters, or none."""
    if quick is not None:
        return quick_filter(df, *quick)
    if date_range is not None:
        return date_range_filter(df, "DOE", *date_range)
    if custom is not None:
        return custom_period_filter(df, *custom)
    return df


def breakdown(df: DataFrame, choices: dict[str, list], **period) -> DataFrame:
    """Leavers in the chosen period and groups, per exit period and active filter."""
    chosen = member_filter(by_period(leavers(df), **period), choices)
    return attrition_breakdown(chosen, active_filters(choices))
