"""Reading and writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headcount.functions.dates import coerce_dates
from headcount.sources.templates import REQUIRED_DATES, require_columns, template_schema


def _header(spark: SparkSession, path: str) -> list[str]:
    # No inference: reads the first line only.
    return spark.read.option("header", True).option("inferSchema", False).csv(path).columns


def read_table(
    spark: SparkSession, path: str, template: str | T.StructType | None = None
) -> DataFrame:
    """Read a CSV with a header, typed by the template of its kind or by a schema.

    Columns are matched by name, so a file may hold them in any order, lack
    optional ones, or carry extra ones (kept as text). A missing required date
    column is an error; a value that is no date or number becomes null.
    Without a template, Spark infers the types.
    """
    if template is None:
        return nan_to_null(spark.read.option("header", True).option("inferSchema", True).csv(path))
    named = isinstance(template, str)
    fields = {f.name.lower(): f for f in (template_schema(template) if named else template).fields}
    text = T.StructType([T.StructField(c, T.StringType()) for c in _header(spark, path)])
    raw = strip_column_names(spark.read.option("header", True).option("enforceSchema", False).schema(text).csv(path))
    if named:
        require_columns(raw, list(REQUIRED_DATES[template]))
    dates = [c for c in raw.columns if _kind(fields, c) == "date"]
    typed = coerce_dates(raw, dates)
    return nan_to_null(
        typed.select(
            [
                F.col(f"`{c}`").try_cast(fields[c.lower()].dataType).alias(c)
                if _kind(fields, c) == "number"
                else F.col(f"`{c}`")
                for c in typed.columns
            ]
        )
    )


def _kind(fields: dict[str, T.StructField], column: str) -> str:
    field = fields.get(column.lower())
    if field is None or isinstance(field.dataType, T.StringType):
        return "text"
    return "date" if isinstance(field.dataType, T.DateType) else "number"


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))


def nan_to_null(df: DataFrame) -> DataFrame:
    """One notion of missing: floating NaN becomes null."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not floating:
        return df
    return df.select(
        [
            F.nanvl(F.col(f"`{c}`"), F.lit(None)).alias(c) if c in floating else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def strip_column_names(df: DataFrame) -> DataFrame:
    """Trim white space around the header names."""
    return df.toDF(*[c.strip() for c in df.columns])


def write_csv(df: DataFrame, path: str) -> str:
    """Write `df` as a folder of CSV parts, each with a header."""
    df.write.option("header", True).mode("errorifexists").csv(path)
    return path


def input_template(df: DataFrame, key: str, target: str, n: int = 5) -> DataFrame:
    """The first rows without the target, as a file to fill in for scoring."""
    return df.orderBy(key).limit(n).drop(target)


def preview(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """First `n` rows in key order (a top-n per partition, then one merge)."""
    return df.orderBy(key).limit(n)


def shape(df: DataFrame) -> DataFrame:
    """One row: number of rows and of columns."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))
