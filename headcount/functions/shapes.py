"""Schema lookups and wide-to-long helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {
    "numeric": (T.NumericType,),
    "string": (T.StringType,),
    "datetime": (T.DateType, T.TimestampType, T.TimestampNTZType),
}


def columns_by_kind(df: DataFrame, kind: str) -> list[str]:
    """Numeric, string or datetime columns, in schema order; booleans are none of them."""
    if kind not in _KINDS:
        raise ValueError(f"kind is one of {', '.join(_KINDS)}")
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _KINDS[kind])]


def melt(df: DataFrame, columns: list[str], kind: str, keep: list[str] | None = None) -> DataFrame:
    """Long form (column, value) of some columns, cast to one type; one scan for all."""
    keep = keep or []
    cast = df.select(*keep, *[F.col(f"`{c}`").cast(kind).alias(c) for c in columns])
    return cast.unpivot(keep, [F.col(f"`{c}`") for c in columns], "column", "value")


def with_stats(df: DataFrame, stats: DataFrame, columns: list[str], fields: list[str]) -> DataFrame:
    """Add `_stats`: for each column a struct of its fields, the same in every row.

    `stats` has one row per column name. It becomes one scalar subquery, which
    the row expressions then share.
    """

    def one(name: str, field: str) -> Column:
        return F.max(F.when(F.col("column") == name, F.col(field))).alias(field)

    wide = stats.agg(*[F.struct(*[one(c, f) for f in fields]).alias(c) for c in columns])
    return df.withColumn("_stats", wide.select(F.struct(*[F.col(f"`{c}`") for c in columns])).scalar())


def stat(column: str, field: str) -> Column:
    return F.col("_stats")[column][field]
