"""Projections: dropping, deriving and aligning columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headcount.functions.dates import age, requisition_days, tenure_current, tenure_effective, tenure_exited


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop columns; names that are absent are passed over."""
    return df.drop(*columns)


def align_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Exactly the wanted columns in their order; an absent one is filled with 0.

    Names are matched without regard to case, as everywhere in a query.
    """
    known = {c.lower(): c for c in df.columns}
    return df.select(
        [
            F.col(f"`{known[c.lower()]}`").alias(c) if c.lower() in known else F.lit(0.0).alias(c)
            for c in wanted
        ]
    )


def with_attrition_measures(df: DataFrame, as_of: str) -> DataFrame:
    """Tenure of leavers (null for others) and age."""
    return df.withColumns({"Tenure": tenure_exited(), "Age": age(as_of)})


def with_prediction_measures(df: DataFrame, as_of: str) -> DataFrame:
    """Tenure up to the exit or `as_of`, and age."""
    return df.withColumns({"Tenure": tenure_effective(as_of), "Age": age(as_of)})


def with_diversity_measures(df: DataFrame, as_of: str) -> DataFrame:
    """Tenure up to `as_of` for everyone, and age."""
    return df.withColumns({"Tenure": tenure_current(as_of), "Age": age(as_of)})


def with_requisition_days(df: DataFrame, as_of: str, received: str) -> DataFrame:
    return df.withColumn("Days", requisition_days(as_of, received))
