"""Date columns: parsing, durations, exit calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Days in a year, and the formats tried for dates of unknown
# layout, day before month where the text allows both.
DAYS_PER_YEAR = 365.25
MIXED_FORMATS = (
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "d-M-yyyy",
    "d/M/yyyy",
    "d.M.yyyy",
    "M-d-yyyy",
    "M/d/yyyy",
    "M.d.yyyy",
    "d MMM yyyy",
    "d-MMM-yyyy",
    "d MMMM yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "yyyyMMdd",
    "yyyy-MM-dd HH:mm:ss",
    "d/M/yyyy HH:mm:ss",
    "d-M-yyyy HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX][X]",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS][XXX][X]",
    "yyyy.MM.dd",
    "d/M/yy",
    "d-M-yy",
    "d.M.yy",
    "M/d/yy",
    "M-d-yy",
    "MMM yyyy",
    "MMMM yyyy",
)
MONTHS = (
    "January",
    "February",
    "March",
    "April",
    "May",
    "June",
    "July",
    "August",
    "September",
    "October",
    "November",
    "December",
)


def _is_date(df: DataFrame, column: str) -> bool:
    return isinstance(
        df.schema[column].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)
    )


def coerce_dates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text to date; what is no date becomes null."""
    return df.withColumns(
        {
            c: F.to_date(F.col(f"`{c}`")) if _is_date(df, c) else F.try_to_date(F.trim(F.col(f"`{c}`")))
            for c in columns
        }
    )


def parse_mixed_dates(df: DataFrame, columns: list[str], dayfirst: bool = True) -> DataFrame:
    """Dates in mixed layouts, rewritten as `yyyy-MM-dd` text.

    Two-digit years are those of this century, a month with a year is its first day, and
    a time with a zone is taken in the session's zone. A non-null value that fits no layout fails the query.
    """
    formats = MIXED_FORMATS
    if not dayfirst:
        # Month-first layouts move ahead of their day-first twins.
        formats = tuple(sorted(MIXED_FORMATS, key=lambda f: f.startswith("d")))

    def parsed(name: str) -> Column:
        c = F.regexp_replace(F.trim(F.col(f"`{name}`").cast("string")), "(?i)\\bsept\\b", "Sep")
        attempts = [F.try_to_timestamp(c, F.lit(f)) for f in formats]
        text = F.date_format(F.coalesce(*attempts), "yyyy-MM-dd")
        failure = F.raise_error(F.concat(F.lit(f"no date in column {name}: "), c))
        return F.when(c.isNotNull() & text.isNull(), failure.cast("string")).otherwise(text)

    return df.withColumns({c: parsed(c) for c in columns})


def years_between(start: str | Column, end: str | Column) -> Column:
    """Whole days from start to end in years, one decimal, half to even."""
    start = F.col(start) if isinstance(start, str) else start
    end = F.col(end) if isinstance(end, str) else end
    return F.bround(F.datediff(end, start) / F.lit(DAYS_PER_YEAR), 1)


def as_date(as_of: str) -> Column:
    return F.lit(as_of).cast("date")


def tenure_exited(joined: str = "DOJ", left: str = "DOE") -> Column:
    """Years served by leavers; null while employed."""
    return years_between(joined, left)


def tenure_effective(as_of: str, joined: str = "DOJ", left: str = "DOE") -> Column:
    """Years served up to the exit, or up to `as_of` while employed."""
    return years_between(F.col(joined), F.coalesce(F.col(left), as_date(as_of)))


def tenure_current(as_of: str, joined: str = "DOJ") -> Column:
    """Years from joining to `as_of`, leavers included."""
    return years_between(F.col(joined), as_date(as_of))


def age(as_of: str, born: str = "DOB") -> Column:
    return years_between(F.col(born), as_date(as_of))


def requisition_days(as_of: str, received: str = "RequisitionDate") -> Column:
    return F.datediff(as_date(as_of), F.col(received))


def exit_calendar(df: DataFrame, left: str = "DOE") -> DataFrame:
    """Year, month number and name, quarter `2024Q2` and month `2024-05` of the exit."""
    d = F.col(left)
    year = F.year(d)
    return df.withColumns(
        {
            "Exit_Year": year,
            "Exit_Month_Num": F.month(d),
            "Exit_Month": F.date_format(d, "MMMM"),
            "Exit_Quarter": F.concat(year.cast("string"), F.lit("Q"), F.quarter(d).cast("string")),
            "Exit_Month_Year": F.date_format(d, "yyyy-MM"),
        }
    )
