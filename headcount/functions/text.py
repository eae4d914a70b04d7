"""Text predicates and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_ci(column: str | Column, text: str) -> Column:
    """Case-insensitive substring test; null counts as no match."""
    c = F.col(f"`{column}`") if isinstance(column, str) else column
    return F.coalesce(F.lower(c.cast("string")).contains(text.lower()), F.lit(False))


def encode_target(column: str | Column) -> Column:
    """`No` to 0 and `Yes` to 1, as written; any other text to null."""
    c = F.col(f"`{column}`") if isinstance(column, str) else column
    return F.when(c == "No", 0).when(c == "Yes", 1)
