import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from headcount.operators import profile, quality


def test_actions_at_the_limits(spark):
    n = 100
    df = spark.range(n).select(
        *[
            F.when(F.col("id") >= nulls, F.col("id")).alias(name)
            for name, nulls in (("none", 0), ("five", 5), ("six", 6), ("thirty", 30), ("more", 31))
        ]
    )
    assert quality.null_actions(df) == {
        "none": "No action required",
        "five": "Drop Rows",
        "six": "Impute",
        "thirty": "Impute",
        "more": "Drop Column",
    }


def test_mode_ties_take_the_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,)], "s string")
    assert quality.modes(df, ["s"]).first()["mode"] == "a"
    assert quality.impute_mode(df, ["s"]).where("s = 'a'").count() == 3


def test_mode_of_dates_keeps_the_type(spark):
    df = spark.sql("select explode(array(date'2020-01-02', date'2020-01-02', date'2019-01-01', null)) d")
    filled = quality.impute_mode(df, ["d"])
    assert dict(filled.dtypes) == {"d": "date"}
    assert filled.where("d = date'2020-01-02'").count() == 3


def test_clean_fills_from_the_rows_that_are_left(spark):
    # Dropping the rows without a key removes the value that would win the mode.
    rows = [(None, "x", 100.0)] * 5 + [(i, "y", 1.0) for i in range(60)]
    rows += [(i, None, None) for i in range(60, 80)] + [(i, "x", 3.0) for i in range(80, 120)]
    df = spark.createDataFrame(rows, "k int, s string, v double")
    cleaned = quality.clean(df)
    assert cleaned.count() == 120
    assert cleaned.where("s = 'y'").count() == 80
    assert cleaned.where("k between 60 and 79").select("v").distinct().collect()[0][0] == 1.0


def test_mean_only_where_asked(spark):
    rows = [(float(i * i), float(i * i)) for i in range(9)] + [(None, None)]
    df = spark.createDataFrame(rows, "Age double, Pay double")
    filled = quality.clean(df, mean_columns=("Age",)).tail(1)[0]
    assert filled["Age"] == pytest.approx(np.mean([i * i for i in range(9)]))
    assert filled["Pay"] == 16.0


def test_empty_columns_are_dropped(spark):
    df = spark.range(10).withColumn("gone", F.lit(None).cast("string"))
    assert quality.clean(df).columns == ["id"]


def _pandas_remove(frame, columns):
    for c in columns:
        q1, q3 = frame[c].quantile(0.25), frame[c].quantile(0.75)
        reach = 1.5 * (q3 - q1)
        frame = frame[~((frame[c] < q1 - reach) | (frame[c] > q3 + reach))]
    return frame


def test_remove_is_sequential_and_keeps_null(spark):
    rng = np.random.default_rng(7)
    frame = pd.DataFrame({"a": rng.standard_t(2, 400), "b": rng.standard_t(2, 400)})
    frame.loc[::17, "a"] = None
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "a double, b double")
    for order in (["a", "b"], ["b", "a"]):
        got = quality.iqr_remove(df, order).toPandas()
        want = _pandas_remove(frame, order)
        assert len(got) == len(want) and got["a"].isna().sum() == want["a"].isna().sum()
        assert np.allclose(np.sort(got["b"]), np.sort(want["b"]))


def test_value_on_the_fence_is_no_outlier(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 3, 4, 7, -3)], "x double")
    # Quartiles 0.5 and 3.5, fences -4 and 8.
    bounds = quality.iqr_bounds(df.union(spark.createDataFrame([(None,)], "x double")), ["x"]).first()
    assert (bounds["lower"], bounds["upper"], bounds["outliers"]) == (-4.0, 8.0, 0)


def test_impute_uses_the_median_with_outliers(spark):
    values = [1.0, 2.0, 3.0, 4.0, 1000.0, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in quality.iqr_impute(df, ["x"]).collect()] == [1.0, 2.0, 3.0, 4.0, 3.0, None]


def test_methods(spark):
    df = spark.range(4).select(F.col("id").cast("double").alias("x"))
    assert quality.handle_outliers(df, ["x"]) is df
    assert quality.handle_outliers(df, ["x"], "Remove").count() == 4
    assert quality.handle_outliers(df, ["x"], "Impute").count() == 4
    with pytest.raises(ValueError):
        quality.handle_outliers(df, ["x"], "Clip")


def test_profiles_equal_pandas(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"u": rng.gamma(2.0, 5.0, 500), "v": rng.normal(size=500)})
    frame.loc[::9, "v"] = None
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "u double, v double")
    got = {r["column"]: r for r in profile.describe_extended(df, ["u", "v"]).collect()}
    want = frame.describe()
    for c in ("u", "v"):
        for ours, theirs in zip(
            ("count", "mean", "std", "min", "q25", "q50", "q75", "max"),
            ("count", "mean", "std", "min", "25%", "50%", "75%", "max"),
        ):
            assert got[c][ours] == pytest.approx(want[c][theirs])
        assert got[c]["skewness"] == pytest.approx(frame[c].skew())
        assert got[c]["kurtosis"] == pytest.approx(frame[c].kurt())


def test_categorical_profile(spark):
    df = spark.createDataFrame([("a", None), ("b", None), ("a", None), (None, None)], "s string, e string")
    got = {r["column"]: tuple(r)[1:] for r in profile.describe_categorical(df, ["s", "e"]).collect()}
    assert got == {"s": (3, 2, "a", 2), "e": (0, 0, None, None)}
    counted = {r["column"]: tuple(r)[1:] for r in profile.column_profile(df).collect()}
    assert counted == {"s": ("string", 2, 1), "e": ("string", 0, 4)}
    rough = {r["column"]: tuple(r)[1:] for r in profile.column_profile(df, approximate=True).collect()}
    assert rough == counted
    assert tuple(profile.overview(df).first()) == (4, 2, 5)
