import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from headcount.functions.shapes import columns_by_kind
from headcount.sources import tables, templates


def _file(tmp_path, text, name="in.csv"):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


# The header is fixed: the column names of the template.
PREDICTION = (
    "EmployeeID,Department,Job level,DOJ,DOB,DOE,Gender,DEIGroup,Country,Reason for Leaving,Salary,"
    "Engagement Score,Performance Score,Training Hours,Number of Projects,Overtime,"
    "Promotion in Last 3 Years,Work-Life Balance,Turnover\n"
    "W-77,Workshop,7 to 9,2016-04-05,1979-08-20,2021-06-31,Female,No,Norway,Moved away,48250.5,5,2,64,1,"
    "No,Yes,2,No\n"
)


def test_prediction_template_row(spark, tmp_path):
    df = tables.read_table(spark, _file(tmp_path, PREDICTION), "prediction")
    row = df.first()
    assert row["DOE"] is None  # there is no 31 June
    assert row["DOJ"] == dt.date(2016, 4, 5)
    assert row["Salary"] == 48250.5 and row["Engagement Score"] == 5
    assert df.columns == [f.name for f in templates.template_schema("prediction").fields]


def test_row_one_value_short_and_bad_number(spark, tmp_path):
    names = [f.name for f in templates.template_schema("recruitment").fields]
    text = ",".join(names) + "\nLegal,Clerk,4,yes,Chile,2023-09-14,Campus,Female,few,no,yes,dropout\n"
    row = tables.read_table(spark, _file(tmp_path, text), "recruitment").first()
    assert row["Joined or Dropout"] is None
    assert row["Candidate Experience (Years)"] is None
    assert row["Date of Requisition Received"] == dt.date(2023, 9, 14)


def test_columns_match_by_name_in_any_order(spark, tmp_path):
    text = " DOE , DOJ ,DOB,Extra,Department\n,2020-01-02,1990-01-01,x,HR\n"
    row = tables.read_table(spark, _file(tmp_path, text), "attrition").first()
    assert row["DOJ"] == dt.date(2020, 1, 2) and row["DOE"] is None
    assert row["Extra"] == "x" and row["Department"] == "HR"


@pytest.mark.parametrize("kind", ["engagement", "performance"])
def test_missing_date_column_is_an_error(spark, tmp_path, kind):
    text = "EmployeeID,Department,DOJ,Age,Attrition\nE-9,Legal,2018-03-07,31,No\n"
    with pytest.raises(KeyError, match="DOE"):
        tables.read_table(spark, _file(tmp_path, text), kind)


def test_unknown_template():
    with pytest.raises(ValueError, match="no template"):
        templates.template_schema("payroll")


def test_require_columns_ignores_case(spark):
    df = spark.createDataFrame([(1,)], "`Job Level` int")
    assert templates.require_columns(df, ["Job level"]) is df
    with pytest.raises(KeyError, match="Gender"):
        templates.require_columns(df, ["Gender"])


def test_strip_column_names_and_nan(spark):
    df = spark.createDataFrame([(math.nan, 1)], "` a ` double, b int")
    assert tables.strip_column_names(df).columns == ["a", "b"]
    assert tables.nan_to_null(df).first()[0] is None


def test_write_csv_refuses_to_overwrite(spark, tmp_path):
    path = str(tmp_path / "out")
    tables.write_csv(spark.range(3), path)
    assert spark.read.option("header", True).csv(path).count() == 3
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        tables.write_csv(spark.range(3), path)


def test_inferred_without_template(spark, tmp_path):
    df = tables.read_table(spark, _file(tmp_path, "a,b\n1,x\n2,y\n"))
    assert dict(df.dtypes) == {"a": "int", "b": "string"}


def test_columns_by_kind(spark):
    df = spark.range(1).select(
        F.lit(1).alias("i"),
        F.lit(1.5).alias("d"),
        F.lit("s").alias("s"),
        F.lit(True).alias("flag"),
        F.current_date().alias("day"),
    )
    assert columns_by_kind(df, "numeric") == ["i", "d"]
    assert columns_by_kind(df, "string") == ["s"]
    assert columns_by_kind(df, "datetime") == ["day"]
    with pytest.raises(ValueError):
        columns_by_kind(df, "bool")
