"""Counts of categories, of attrition by period and of diversity dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headcount.functions.dates import MONTHS
from headcount.functions.shapes import melt

# The dimensions a diversity view looks for.
DIVERSITY_DIMENSIONS = (
    "Gender",
    "LGBTQ",
    "Indigenous",
    "Ethnicity",
    "Disability",
    "Minority",
    "Veteran",
    "Country",
)
# The periods every attrition breakdown shows.
EXIT_PERIODS = ("Exit_Year", "Exit_Month", "Exit_Quarter")
# The column that holds the period of each comparison.
GRAINS = {"year": "Exit_Year", "quarter": "Exit_Quarter", "month": "Exit_Month"}
# A crosstab has one output column per value of its second key.
MAX_PIVOT = 1000


def _count() -> Column:
    return F.count(F.lit(1)).alias("count")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per non-null value, most frequent first."""
    c = F.col(f"`{column}`")
    return (
        df.where(c.isNotNull())
        .groupBy(c.alias("value"))
        .agg(_count())
        .orderBy(F.desc("count"), "value")
    )


def pair_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows per pair; a null in either key leaves the row out."""
    return df.dropna(subset=[a, b]).groupBy(a, b).agg(_count())


def crosstab(df: DataFrame, a: str, b: str, max_columns: int = MAX_PIVOT) -> DataFrame:
    """Contingency table of `a` by `b`, zero where a pair does not occur.

    The values of `b` become columns, so they are read on the driver; for a key
    with more of them than a table can have columns use `pair_counts`.
    """
    pairs = df.dropna(subset=[a, b])
    found = pairs.select(b).distinct().limit(max_columns + 1).collect()
    if len(found) > max_columns:
        raise ValueError(f"'{b}' has more than {max_columns} values; use pair_counts")
    values = sorted(r[0] for r in found)
    return pairs.groupBy(a).pivot(b, values).agg(F.count(F.lit(1))).na.fill(0)


def to_long(wide: DataFrame, keep: list[str], variable: str = "variable", value: str = "value") -> DataFrame:
    """Wide to long: every column but the kept ones becomes rows."""
    rest = [c for c in wide.columns if c not in keep]
    return wide.unpivot(keep, [F.col(f"`{c}`") for c in rest], variable, value)


def crosstab_long(df: DataFrame, a: str, b: str) -> DataFrame:
    """The crosstab as rows (a, variable, value), zeros included.

    Nothing is pivoted, so `b` may have any number of values: each value of `a` is
    paired with the list of them, and the counted pairs are joined to that. Rows with
    a null in either key are left out; an empty table gives no rows.
    """
    left, right = F.col(f"`{a}`").alias("_a"), F.col(f"`{b}`").alias("_b")
    pairs = df.select(left, right).dropna().groupBy("_a", "_b").agg(_count())
    levels = pairs.agg(F.collect_set("_b")).scalar()
    cells = pairs.select("_a").distinct().withColumn("_b", F.explode(levels))
    return cells.join(pairs, ["_a", "_b"], "left").select(
        F.col("_a").alias(a),
        F.col("_b").cast("string").alias("variable"),
        F.coalesce("count", F.lit(0)).cast("bigint").alias("value"),
    )


def present_dimensions(df: DataFrame, dimensions: tuple[str, ...] = DIVERSITY_DIMENSIONS) -> list[str]:
    return [c for c in dimensions if c in df.columns]


def dimension_counts(df: DataFrame, dimensions: list[str]) -> DataFrame:
    """Rows per value of each dimension, nulls left out; one scan for all."""
    return (
        melt(df, dimensions, "string")
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(_count())
    )


def category_shares(df: DataFrame, dimensions: list[str]) -> DataFrame:
    """The same with the share of all rows in percent, two decimals."""
    rows = df.agg(_count()).scalar()
    share = F.bround(F.col("count") / rows * F.lit(100.0), 2)
    return dimension_counts(df, dimensions).withColumn("pct", share)


def dimension_status(df: DataFrame, dimensions: list[str]) -> DataFrame:
    """Per dimension: whether it has no data, one category, or a breakdown."""
    counts = melt(df, dimensions, "string").groupBy("column", "value").agg(_count())
    present = F.col("value").isNotNull()
    seen = counts.groupBy("column").agg(
        F.count_if(present).alias("categories"), F.min("value").alias("first")
    )
    status = (
        F.when(F.col("categories") == 0, "no data")
        .when(F.col("categories") == 1, "single category")
        .otherwise("breakdown")
    )
    return seen.select(
        "column",
        "categories",
        status.alias("status"),
        F.when(F.col("categories") == 1, F.col("first")).alias("category"),
    )


def attrition_breakdown(df: DataFrame, active: list[str] | None = None) -> DataFrame:
    """Leavers per exit year, month and quarter, and per column with an active filter."""
    return dimension_counts(df, [*EXIT_PERIODS, *(active or [])])


def monthly_pattern(df: DataFrame) -> DataFrame:
    """Leavers per month name, all years together, in calendar order."""
    names = F.array(*[F.lit(m) for m in MONTHS])
    return (
        df.where(F.col("Exit_Month").isNotNull())
        .groupBy("Exit_Month")
        .agg(_count())
        .select(F.array_position(names, F.col("Exit_Month")).cast("int").alias("month_num"), "Exit_Month", "count")
        .orderBy("month_num")
    )


def quarterly_distribution(df: DataFrame) -> DataFrame:
    """Leavers per quarter and their share in percent."""
    present = df.where(F.col("Exit_Quarter").isNotNull())
    rows = present.agg(_count()).scalar()
    return (
        present.groupBy("Exit_Quarter")
        .agg(_count())
        .withColumn("pct", F.bround(F.col("count") / rows * F.lit(100.0), 2))
        .orderBy("Exit_Quarter")
    )


def period_compare(df: DataFrame, grain: str, first=None, second=None) -> DataFrame:
    """Leavers in two periods; by default the first and the last one in sort order.

    Month names sort as text. The counts per period are as few as the calendar
    allows, so the choice is made on them.
    """
    column = GRAINS[grain]
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("p")).agg(_count())

    def chosen(given, extreme) -> tuple[Column, Column]:
        if given is None:
            pick = F.min_by if extreme is F.min else F.max_by
            return extreme("p"), pick("count", "p")
        return F.lit(given), F.coalesce(F.sum(F.when(F.col("p") == given, F.col("count"))), F.lit(0))

    p1, n1 = chosen(first, F.min)
    p2, n2 = chosen(second, F.max)
    return counts.agg(
        F.max(p1) if first is not None else p1.alias("_p1"),
        n1.alias("count_1"),
        F.max(p2) if second is not None else p2.alias("_p2"),
        n2.alias("count_2"),
    ).toDF("period_1", "count_1", "period_2", "count_2")


def date_extent(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("first"), F.max(column).alias("last"))
