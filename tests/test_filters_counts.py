import datetime as dt

import pytest
from pyspark.sql import functions as F

from headcount.functions.text import contains_ci, encode_target
from headcount.operators import counts, filters, recruiting
from headcount.plans import attrition


@pytest.fixture(scope="module")
def staff(spark):
    rows = [
        ("HR", "F", dt.date(2023, 3, 5)),
        ("HR", "M", dt.date(2024, 3, 9)),
        ("IT", "F", dt.date(2024, 7, 1)),
        ("IT", None, None),
        (None, "F", dt.date(2024, 3, 31)),
    ]
    return spark.createDataFrame(rows, "Department string, Gender string, DOE date")


def test_month_without_year_spans_years(staff):
    gone = attrition.leavers(staff)
    assert filters.quick_filter(gone, None, "March").count() == 3
    assert filters.quick_filter(gone, 2024, "March").count() == 2
    assert filters.quick_filter(gone).count() == 4


def test_date_range_is_inclusive(staff):
    assert filters.date_range_filter(staff, "DOE", "2024-03-09", "2024-07-01").count() == 3
    assert filters.date_range_filter(staff, "DOE", None, "2023-03-05").count() == 1
    assert filters.date_range_filter(staff, "DOE").count() == 4


def test_all_lifts_a_column(staff):
    choices = {"Department": ["All", "HR"], "Gender": ["F"]}
    assert filters.member_filter(staff, choices).count() == 3
    assert filters.active_filters(choices) == ["Gender"]


def test_options_drop_null_and_sort_as_text(staff):
    months = filters.distinct_options(attrition.leavers(staff), "Exit_Month")
    assert [r[0] for r in months.collect()] == ["July", "March"]
    assert [r[0] for r in filters.distinct_options(staff, "Department").collect()] == ["HR", "IT"]


def test_summary_counts_null_as_dropped(staff):
    assert tuple(filters.filter_summary(staff, F.col("Gender") == "F").first()) == (3, 5)


def test_breakdown_has_periods_and_active_filters_only(staff):
    got = attrition.breakdown(staff, {"Gender": ["F"], "Department": ["All"]}, quick=(2024, None))
    found = {(r["column"], r["value"]): r["count"] for r in got.collect()}
    assert found == {
        ("Exit_Year", "2024"): 2,
        ("Exit_Month", "March"): 1,
        ("Exit_Month", "July"): 1,
        ("Exit_Quarter", "2024Q1"): 1,
        ("Exit_Quarter", "2024Q3"): 1,
        ("Gender", "F"): 2,
    }


def test_custom_period(staff):
    got = attrition.by_period(attrition.leavers(staff), custom=(2023, 2023, ["March", "May"]))
    assert got.count() == 1


def test_months_pool_years_in_calendar_order(staff):
    got = counts.monthly_pattern(attrition.leavers(staff)).collect()
    assert [tuple(r) for r in got] == [(3, "March", 3), (7, "July", 1)]


def test_quarter_shares_sum_to_100(staff):
    got = counts.quarterly_distribution(attrition.leavers(staff)).collect()
    assert sum(r["pct"] for r in got) == 100.0


def test_compare_defaults_to_first_and_last_option(staff):
    gone = attrition.leavers(staff)
    assert tuple(counts.period_compare(gone, "month").first()) == ("July", 1, "March", 3)
    assert tuple(counts.period_compare(gone, "year", 2024, 1999).first()) == (2024, 3, 1999, 0)


def test_null_keys_leave_the_counts(staff):
    assert {tuple(r) for r in counts.value_counts(staff, "Gender").collect()} == {("F", 3), ("M", 1)}
    assert counts.pair_counts(staff, "Department", "Gender").count() == 3
    table = {r["Department"]: (r["F"], r["M"]) for r in counts.crosstab(staff, "Department", "Gender").collect()}
    assert table == {"HR": (1, 1), "IT": (1, 0)}
    assert counts.crosstab_long(staff, "Department", "Gender").count() == 4


def test_long_crosstab_has_no_limit(spark):
    """As the pivoted table where that exists; any number of values, none in an empty table."""
    df = spark.createDataFrame(
        [("x", 1), ("x", 1), ("x", 2), ("y", 3), (None, 1), ("z", None)], "`a b` string, k int"
    )
    got = {(r["a b"], r["variable"]): r["value"] for r in counts.crosstab_long(df, "a b", "k").collect()}
    wide = counts.crosstab(df, "a b", "k").collect()
    assert got == {(r["a b"], c): r[c] for r in wide for c in ("1", "2", "3")}
    many = spark.range(1500).select(F.col("id").alias("b"), (F.col("id") % 3).alias("a"))
    rows = counts.crosstab_long(many, "a", "b")
    assert rows.count() == 4500
    assert rows.agg(F.sum("value")).first()[0] == 1500
    assert counts.crosstab_long(df.limit(0), "a b", "k").collect() == []


def test_crosstab_refuses_wide_keys(spark):
    df = spark.range(20).select(F.col("id").alias("a"), F.col("id").cast("string").alias("b"))
    with pytest.raises(ValueError, match="pair_counts"):
        counts.crosstab(df, "a", "b", max_columns=10)


def test_shares_are_of_all_rows(staff):
    got = {r["value"]: r["pct"] for r in counts.category_shares(staff, ["Gender"]).collect()}
    assert got == {"F": 60.0, "M": 20.0}


def test_statuses(spark):
    df = spark.createDataFrame([("x", None, "p"), (None, None, "q")], "a string, b string, c string")
    got = {r["column"]: (r["status"], r["category"]) for r in counts.dimension_status(df, ["a", "b", "c"]).collect()}
    assert got == {"a": ("single category", "x"), "b": ("no data", None), "c": ("breakdown", None)}


def test_contains_and_target(spark):
    df = spark.createDataFrame([("Not Joined",), ("JOINED",), ("Dropout",), (None,)], "s string")
    assert [r[0] for r in df.select(contains_ci("s", "Joined")).collect()] == [True, True, False, False]
    df = spark.createDataFrame([("Yes",), ("No",), ("yes",), (None,)], "s string")
    assert [r[0] for r in df.select(encode_target("s")).collect()] == [1, 0, None, None]


@pytest.fixture(scope="module")
def applicants(spark):
    rows = [
        ("A", "Yes", "yes", "YES", "Joined", 10),
        ("A", "yes", "Yes", "no", "Dropout", 20),
        ("A", "No", "Yes", "Yes", "Joined", 30),
        ("B", None, "Yes", "Yes", "Not Joined", 40),
        (None, "Yes", "No", "Yes", "Joined", 50),
    ]
    names = "Department string, i string, s string, o string, j string, Days int"
    return spark.createDataFrame(rows, names)


NAMES = recruiting.CandidateColumns("i", "s", "o", "j")


def test_funnel_is_nested(applicants):
    got = recruiting.recruitment_funnel(applicants, NAMES).collect()
    assert [r["count"] for r in got] == [5, 3, 2, 1, 1]
    assert [r["rate"] for r in got] == [None, 60.0, 66.67, 50.0, 100.0]


def test_funnel_after_an_empty_stage(applicants):
    got = recruiting.recruitment_funnel(applicants.where("i = 'No'"), NAMES).collect()
    assert [(r["count"], r["rate"]) for r in got][1:] == [(0, 0.0)] * 4


def test_flags_and_groups(applicants):
    flagged = recruiting.with_funnel_flags(applicants, "Days", NAMES)
    got = {r["Department"]: r["Interview Ratio"] for r in recruiting.interview_ratio(flagged, "Department").collect()}
    assert got == {"A": pytest.approx(2 / 3), "B": 0.0}
    stages = recruiting.funnel_by_group(flagged, "Department").collect()
    assert {(r["Department"], r["Funnel Stage"], r["Count"]) for r in stages} == {
        ("A", "Joined", 1), ("A", "Shortlisted", 1), ("A", "Requisitions", 1), ("B", "Requisitions", 1),
    }


def test_own_columns_are_kept(applicants):
    own = applicants.withColumn("Interviewed", F.lit(1)).withColumn("Funnel Stage", F.lit("Hired"))
    flagged = recruiting.with_funnel_flags(own, "Days", NAMES)
    assert {(r["Interviewed"], r["Funnel Stage"]) for r in flagged.collect()} == {(1, "Hired")}


def test_time_to_hire_of_one_row_has_no_deviation(applicants):
    got = recruiting.time_to_hire(applicants, "Department", days="Days", names=NAMES).collect()
    found = {r["Department"]: tuple(r)[1:] for r in got}
    assert found["B"] == (40, 40.0, 40.0, 40, 1, None)
    assert found["A"][:5] == (10, 20.0, 20.0, 30, 2)
