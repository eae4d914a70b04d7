"""Feature preparation: one fitted plan serves training and scoring alike."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headcount.functions.dates import parse_mixed_dates
from headcount.functions.ordering import hash_order, smallest_by_hash
from headcount.functions.shapes import melt
from headcount.functions.text import encode_target
from headcount.operators.columns import align_columns
from headcount.operators.quality import modes

# Each category but the first becomes a column.
MAX_CATEGORIES = 1000
NULL_NAME = "nan"


@dataclass(frozen=True)
class FeaturePlan:
    """Categories, modes and ranges found in the training table.

    `categories` lists the values of each column in order, a null last if there
    was one; the first gets no output column.
    """

    categories: dict[str, list[str | None]] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)

    @property
    def outputs(self) -> list[str]:
        encoded = [_name(c, v) for c, values in self.categories.items() for v in values[1:]]
        return [*self.ranges, *encoded]

    def one_hot(self, df: DataFrame) -> DataFrame:
        """Replace each category column by one 0/1 column per value but the first.

        A value that was not seen in training gives zeros.
        """
        added = [
            _equals(c, v).cast("double").alias(_name(c, v))
            for c, values in self.categories.items()
            for v in values[1:]
        ]
        kept = [F.col(f"`{c}`") for c in df.columns if c not in self.categories]
        return df.select(*kept, *added)

    def scale(self, df: DataFrame) -> DataFrame:
        """Map each numeric column's training range to 0..1; a constant becomes 0."""
        return df.withColumns(
            {
                c: (F.col(f"`{c}`").cast("double") - F.lit(lo)) / F.lit((hi - lo) or 1.0)
                for c, (lo, hi) in self.ranges.items()
            }
        )

    def fill(self, df: DataFrame) -> DataFrame:
        """Null categories become the training mode."""
        return df.withColumns(
            {c: F.coalesce(F.col(f"`{c}`"), F.lit(m)) for c, m in self.modes.items() if m is not None}
        )

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """The training columns in the training order, after the kept ones."""
        ready = self.scale(self.one_hot(df))
        return ready.select(*(keep or []), *[F.col(f"`{c}`") for c in self.outputs])

    def prepare_batch(
        self, df: DataFrame, keep: list[str] | None = None, dates: tuple[str, ...] = ()
    ) -> DataFrame:
        """`transform` for a table to score, whatever it lacks.

        Names are matched without regard to case. Dates in mixed layouts become
        `yyyy-MM-dd` text, missing categories the training mode. A training column that
        is absent, and a missing number, become 0 after scaling; others are dropped.
        """
        known = {c.lower(): c for c in df.columns}
        df = parse_mixed_dates(df, [known[c.lower()] for c in dates if c.lower() in known])
        wanted = [*self.categories, *self.ranges]
        df = df.withColumnsRenamed(
            {known[c.lower()]: c for c in wanted if c.lower() in known and known[c.lower()] != c}
        )
        here = FeaturePlan(
            *(
                {c: v for c, v in part.items() if c.lower() in known}
                for part in (self.categories, self.modes, self.ranges)
            )
        )
        ready = here.scale(here.one_hot(here.fill(df)))
        ready = ready.fillna(0.0, subset=list(here.ranges))
        return align_columns(ready, [*(keep or []), *self.outputs])


def _name(column: str, value: str | None) -> str:
    return f"{column}_{NULL_NAME if value is None else value}"


def _equals(column: str, value: str | None) -> Column:
    c = F.col(f"`{column}`")
    return c.isNull() if value is None else F.coalesce(c.cast("string") == value, F.lit(False))


def category_values(
    df: DataFrame, columns: list[str], max_categories: int = MAX_CATEGORIES
) -> dict[str, list[str | None]]:
    """The values of each column on the driver, at most `max_categories` of them."""
    if not columns:
        return {}
    limit = len(columns) * max_categories
    found = melt(df, columns, "string").distinct().limit(limit + 1).collect()
    values: dict[str, list[str | None]] = {c: [] for c in columns}
    for row in found:
        values[row["column"]].append(row["value"])
    for column, seen in values.items():
        if len(seen) > max_categories or len(found) > limit:
            raise ValueError(f"'{column}' has more than {max_categories} categories to encode")
        seen.sort(key=lambda v: (v is None, v or ""))
    return values


def fit_features(
    df: DataFrame,
    categorical: list[str],
    numeric: list[str],
    max_categories: int = MAX_CATEGORIES,
) -> FeaturePlan:
    """Read categories, modes and ranges off the training table, a few values per column."""
    top = {}
    if categorical:
        top = {r["column"]: r["mode"] for r in modes(df, categorical).collect()}
    ranges = {}
    if numeric:
        measures = [f(F.col(f"`{c}`").cast("double")) for c in numeric for f in (F.min, F.max)]
        row = df.agg(*[m.alias(f"_{i}") for i, m in enumerate(measures)]).first()
        for i, c in enumerate(numeric):
            lo, hi = row[2 * i], row[2 * i + 1]
            if lo is not None:
                ranges[c] = (lo, hi)
    return FeaturePlan(category_values(df, categorical, max_categories), top, ranges)


def one_hot(df: DataFrame, columns: list[str]) -> DataFrame:
    return FeaturePlan(categories=category_values(df, columns)).one_hot(df)


def min_max_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    return fit_features(df, [], columns).scale(df)


def with_target(df: DataFrame, target: str, name: str = "label") -> DataFrame:
    """Add the 0/1 label: text Yes/No is mapped, a number is taken as it is."""
    textual = df.schema[target].dataType.typeName() == "string"
    label = encode_target(target) if textual else F.col(f"`{target}`")
    return df.withColumn(name, label.cast("double"))


def train_test_split(df: DataFrame, key: str, pct: int = 20, seed: int = 42) -> DataFrame:
    """Add `is_test`: true for the first `pct` percent, rounded up, in hash order of the key.

    `key` names a row; the same key always falls on the same side.
    """
    if not 10 <= pct <= 50:
        raise ValueError("the test share is between 10 and 50 percent")
    wanted = df.agg(F.ceil(F.count(F.lit(1)) * F.lit(pct) / F.lit(100)).alias("k"))
    last = smallest_by_hash(df, key, seed, [], wanted).select("last").scalar()
    order = F.struct(hash_order(key, seed).alias("_hash"), F.col(key).alias("_key"))
    return df.withColumn("is_test", F.coalesce(order <= last, F.lit(False)))
