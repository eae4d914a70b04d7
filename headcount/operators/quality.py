"""Missing values and outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headcount.functions.ordering import quantiles
from headcount.functions.shapes import columns_by_kind, melt, stat, with_stats

# The actions on missing values and the percentages that end them.
NO_ACTION = "No action required"
DROP_ROWS = "Drop Rows"
IMPUTE = "Impute"
DROP_COLUMN = "Drop Column"
DROP_ROWS_UP_TO = 5
IMPUTE_UP_TO = 30
# Quartiles and the reach of the fences in interquartile ranges.
QUARTILES = {"q1": 0.25, "q3": 0.75}
FENCE = 1.5


def null_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column: percentage of nulls and the action it calls for. One scan, one row shuffled.

    An empty table has no nulls, and calls for no action.
    """
    columns = columns or df.columns
    rows = F.count(F.lit(1))
    wide = df.agg(
        *[
            F.coalesce(
                F.try_divide(rows - F.count(F.col(f"`{c}`")), rows) * F.lit(100.0), F.lit(0.0)
            ).alias(c)
            for c in columns
        ]
    )
    pct = F.col("pct")
    action = (
        F.when(pct == 0, NO_ACTION)
        .when(pct <= DROP_ROWS_UP_TO, DROP_ROWS)
        .when(pct <= IMPUTE_UP_TO, IMPUTE)
        .otherwise(DROP_COLUMN)
    )
    return wide.unpivot([], [F.col(f"`{c}`") for c in columns], "column", "pct").withColumn(
        "action", action
    )


def null_actions(df: DataFrame, columns: list[str] | None = None) -> dict[str, str]:
    """The profile's actions on the driver: one short row per column."""
    return {r["column"]: r["action"] for r in null_profile(df, columns).collect()}


def drop_sparse_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop rows with a null in any of the columns."""
    for c in columns:
        df = df.where(F.col(f"`{c}`").isNotNull())
    return df


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column the most frequent non-null value (as text) and its count, smallest on ties.

    Values are counted before they are compared, so nothing but one candidate
    per task and column reaches the last step.
    """
    counts = (
        melt(df, columns, "string")
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("fewer"), F.col("value"))).alias("best"))
    return best.select(
        "column", F.col("best.value").alias("mode"), (-F.col("best.fewer")).alias("freq")
    )


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per numeric column the exact median of its non-null values, as a double.

    Whole numbers beyond 2^53 are rounded to the nearest double.
    """
    return quantiles(melt(df, columns, "double"), ["column"], "value", {"median": 0.5})


def impute_mode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls of string and date columns become the column's mode."""
    if not columns:
        return df
    known = with_stats(df, modes(df, columns), columns, ["mode"])
    fills = {c: stat(c, "mode").cast(df.schema[c].dataType) for c in columns}
    return known.withColumns({c: F.coalesce(F.col(f"`{c}`"), fills[c]) for c in columns}).drop("_stats")


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls of numeric columns become the column's exact median."""
    if not columns:
        return df
    known = with_stats(df, medians(df, columns), columns, ["median"])
    return known.withColumns(
        {c: F.coalesce(F.col(f"`{c}`").cast("double"), stat(c, "median")) for c in columns}
    ).drop("_stats")


def impute_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls of numeric columns become the column's mean."""
    if not columns:
        return df
    means = df.agg(F.struct(*[F.avg(F.col(f"`{c}`")).alias(c) for c in columns])).scalar()
    known = df.withColumn("_means", means)
    return known.withColumns(
        {c: F.coalesce(F.col(f"`{c}`").cast("double"), F.col("_means")[c]) for c in columns}
    ).drop("_means")


def clean(
    df: DataFrame, columns: list[str] | None = None, mean_columns: tuple[str, ...] = ()
) -> DataFrame:
    """Apply the null policy: drop sparse rows, impute, drop empty columns.

    The profile decides the schema, so it is read on the driver (one row per
    column). The fill values come from the rows that are left and stay lazy.
    `mean_columns` are imputed by the mean in place of the median.
    """
    actions = null_actions(df, columns)

    def having(action: str) -> list[str]:
        return [c for c in df.columns if actions.get(c) == action]

    kept = drop_sparse_rows(df, having(DROP_ROWS))
    impute = having(IMPUTE)
    numeric = set(columns_by_kind(df, "numeric"))
    textual = set(columns_by_kind(df, "string")) | set(columns_by_kind(df, "datetime"))
    by_mean = [c for c in impute if c in numeric and c in mean_columns]
    by_median = [c for c in impute if c in numeric and c not in mean_columns]
    # Columns do not depend on each other, and each fill comes from its own
    # column; the order of the three steps makes no difference.
    filled = impute_mode(kept, [c for c in impute if c in textual])
    filled = impute_median(filled, by_median)
    filled = impute_mean(filled, by_mean)
    return filled.drop(*having(DROP_COLUMN))


def _fences(quartiles: DataFrame) -> DataFrame:
    reach = (F.col("q3") - F.col("q1")) * F.lit(FENCE)
    return quartiles.withColumns({"lower": F.col("q1") - reach, "upper": F.col("q3") + reach})


def fences(df: DataFrame, columns: list[str], extra: dict[str, float] | None = None) -> DataFrame:
    """Per column: quartiles, and fences 1.5 interquartile ranges beyond them."""
    return _fences(quantiles(melt(df, columns, "double"), ["column"], "value", QUARTILES | (extra or {})))


def _outside(column: str) -> Column:
    value = F.col(f"`{column}`").cast("double")
    return (value < stat(column, "lower")) | (value > stat(column, "upper"))


def iqr_bounds(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: quartiles, fences and the number of values beyond a fence."""
    fields = ["q1", "q3", "lower", "upper"]
    known = with_stats(df, fences(df, columns), columns, fields)
    counts = known.agg(
        F.first("_stats").alias("_stats"), *[F.count_if(_outside(c)).alias(f"_{i}") for i, c in enumerate(columns)]
    )
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            *[stat(c, f).alias(f) for f in fields],
            F.col(f"_{i}").alias("outliers"),
        )
        for i, c in enumerate(columns)
    ]
    return counts.select(F.inline(F.array(*rows)))


def iqr_remove(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop outlier rows column by column; later fences see what is left. Null stays.

    Each pair of fences is read on the driver (two numbers) and becomes a
    literal filter, which the next column's scan pushes down to the files.
    """
    for c in columns:
        bounds = fences(df, [c]).collect()
        if not bounds:
            continue
        lower, upper = bounds[0]["lower"], bounds[0]["upper"]
        value = F.col(f"`{c}`")
        df = df.where(value.isNull() | value.between(lower, upper))
    return df


def iqr_impute(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace outliers by the column's median, taken with the outliers still in."""
    if not columns:
        return df
    found = fences(df, columns, {"median": 0.5})
    known = with_stats(df, found, columns, ["lower", "upper", "median"])
    return known.withColumns(
        {
            c: F.when(_outside(c), stat(c, "median")).otherwise(F.col(f"`{c}`").cast("double"))
            for c in columns
        }
    ).drop("_stats")


def handle_outliers(df: DataFrame, columns: list[str], method: str = "None") -> DataFrame:
    """"None" leaves the table as it is, "Remove" drops rows, "Impute" repairs values."""
    if method == "Remove":
        return iqr_remove(df, columns)
    if method == "Impute":
        return iqr_impute(df, columns)
    if method == "None":
        return df
    raise ValueError('method is one of "None", "Remove", "Impute"')
