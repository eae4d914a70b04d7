import datetime as dt

import pytest
from pyspark.sql import functions as F

from headcount.functions import dates


def _column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"d {kind}")


def test_mixed_layouts_are_read_day_first(spark):
    values = ["2024-03-04", "04-03-2024", "4/3/2024", "25/12/2023", "12/25/2023", "4 Mar 2024", None]
    got = [r[0] for r in dates.parse_mixed_dates(_column(spark, values), ["d"]).collect()]
    assert got == [
        "2024-03-04", "2024-03-04", "2024-03-04", "2023-12-25", "2023-12-25", "2024-03-04", None,
    ]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("31/12/24", "2024-12-31"),
        ("2024.05.06", "2024-05-06"),
        ("2024-05-06T10:00:00Z", "2024-05-06"),
        ("2024-05-06T10:00:00.123+00:00", "2024-05-06"),
        ("5 Sept 2024", "2024-09-05"),
        ("May 2024", "2024-05-01"),
        ("June 2024", "2024-06-01"),
    ],
)
def test_further_layouts(spark, text, want):
    assert dates.parse_mixed_dates(_column(spark, [text]), ["d"]).first()[0] == want


def test_mixed_layouts_month_first(spark):
    got = dates.parse_mixed_dates(_column(spark, ["4/3/2024"]), ["d"], dayfirst=False).first()[0]
    assert got == "2024-04-03"


def test_impossible_date_fails_in_mixed_layouts(spark):
    with pytest.raises(Exception, match="no date in column d"):
        dates.parse_mixed_dates(_column(spark, ["2021-06-31"]), ["d"]).collect()


def test_coerce_keeps_rows(spark):
    got = [r[0] for r in dates.coerce_dates(_column(spark, [" 2024-02-29 ", "2023-02-29", "x", None]), ["d"]).collect()]
    assert got == [dt.date(2024, 2, 29), None, None, None]


def test_coerce_of_a_date_column(spark):
    df = _column(spark, [dt.datetime(2024, 1, 2, 3)], "timestamp")
    assert dates.coerce_dates(df, ["d"]).first()[0] == dt.date(2024, 1, 2)


def test_tenure_and_age(spark):
    rows = [(dt.date(2000, 1, 1), dt.date(2001, 1, 1), dt.date(1980, 1, 1)), (dt.date(2000, 1, 1), None, None)]
    df = spark.createDataFrame(rows, "DOJ date, DOE date, DOB date")
    got = df.select(
        dates.tenure_exited(),
        dates.tenure_effective("2010-01-01"),
        dates.tenure_current("2010-01-01"),
        dates.age("2010-01-01"),
    ).collect()
    assert tuple(got[0]) == (1.0, 1.0, 10.0, 30.0)
    assert tuple(got[1]) == (None, 10.0, 10.0, None)


def test_exit_calendar(spark):
    df = spark.createDataFrame([(dt.date(2024, 5, 31),)], "DOE date")
    row = dates.exit_calendar(df).first()
    assert (row.Exit_Year, row.Exit_Month_Num, row.Exit_Month) == (2024, 5, "May")
    assert (row.Exit_Quarter, row.Exit_Month_Year) == ("2024Q2", "2024-05")


def test_requisition_days(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1),)], "RequisitionDate date")
    assert df.select(dates.requisition_days("2024-03-01")).first()[0] == 60
    assert df.select(F.lit(1)).count() == 1
