"""The diversity view: prepare, then count along each dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame

from headcount.operators import counts
from headcount.operators.columns import with_diversity_measures
from headcount.operators.distributions import histogram
from headcount.operators.quality import clean, handle_outliers
from headcount.session import cut_lineage

# Columns imputed by the mean, and bins of the age and tenure charts.
MEAN_COLUMNS = ("Age",)
BINS = 20


def prepare(
    df: DataFrame,
    as_of: str,
    outlier_columns: list[str] | None = None,
    outliers: str = "None",
    store: bool = True,
) -> DataFrame:
    """Derive tenure and age, apply the null policy to every column, treat outliers.

    The result is stored, since the view reads it many times.
    """
    cleaned = clean(with_diversity_measures(df, as_of), mean_columns=MEAN_COLUMNS)
    if outliers == "Remove" and outlier_columns:
        # Each column's fences are a job of their own.
        cleaned = cut_lineage(cleaned)
    ready = handle_outliers(cleaned, outlier_columns or [], outliers)
    return cut_lineage(ready) if store else ready


def summary(df: DataFrame) -> dict[str, DataFrame]:
    """Counts, shares and status of the dimensions that are present; age and tenure bins."""
    dimensions = counts.present_dimensions(df)
    parts: dict[str, DataFrame] = {}
    if dimensions:
        parts["counts"] = counts.dimension_counts(df, dimensions)
        parts["shares"] = counts.category_shares(df, dimensions)
        parts["status"] = counts.dimension_status(df, dimensions)
    for column in ("Age", "Tenure"):
        if column in df.columns:
            parts[column.lower()] = histogram(df, column, BINS)
    return parts


def intersection(df: DataFrame, by: str, compare: str | None = None) -> DataFrame:
    """Two dimensions crossed, in long form; one alone is just counted."""
    return counts.crosstab_long(df, by, compare) if compare else counts.value_counts(df, by)
