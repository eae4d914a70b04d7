"""The recruitment view: prepare, funnel, and the analyses by group."""

from __future__ import annotations

from pyspark.sql import DataFrame

from headcount.operators import recruiting
from headcount.operators.columns import with_requisition_days
from headcount.operators.quality import clean, handle_outliers
from headcount.operators.recruiting import CandidateColumns
from headcount.session import cut_lineage
from headcount.sources.tables import strip_column_names

# Columns imputed by the mean.
MEAN_COLUMNS = ("Age",)
ANALYSES = {
    "Total Profiles": recruiting.total_profiles,
    "Interview Ratio": recruiting.interview_ratio,
    "Offer Ratio": recruiting.offer_ratio,
    "Join Ratio": recruiting.join_ratio,
    "Source Effectiveness": recruiting.source_effectiveness,
    "Funnel Conversion Analysis": recruiting.funnel_by_group,
    "Aging of Requisitions": recruiting.requisition_aging,
}


def prepare(
    df: DataFrame,
    as_of: str,
    received: str = "Date of Requisition Received",
    outlier_columns: list[str] | None = None,
    outliers: str = "None",
    store: bool = True,
) -> DataFrame:
    """Add the days since the requisition, apply the null policy, treat outliers.

    The result is stored, since the view reads it many times.
    """
    cleaned = clean(with_requisition_days(df, as_of, received), mean_columns=MEAN_COLUMNS)
    if outliers == "Remove" and outlier_columns:
        # Each column's fences are a job of their own.
        cleaned = cut_lineage(cleaned)
    ready = strip_column_names(handle_outliers(cleaned, outlier_columns or [], outliers))
    return cut_lineage(ready) if store else ready


def analyse(
    df: DataFrame,
    analysis: str,
    by: str,
    compare: str | None = None,
    names: CandidateColumns = CandidateColumns(),
) -> DataFrame:
    """One of the eight analyses of a prepared table, by one or two keys."""
    if analysis == "Time to Hire":
        return recruiting.time_to_hire(df, by, compare, names=names)
    if analysis not in ANALYSES:
        raise ValueError(f"analysis is one of Time to Hire, {', '.join(ANALYSES)}")
    return ANALYSES[analysis](recruiting.with_funnel_flags(df, "Days", names), by, compare)
