import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from headcount.operators import distributions, timeseries


def _series(spark, values):
    rows = [(i, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "t int, v double")


def test_weeks_start_on_monday_and_null_dates_go(spark):
    df = spark.sql(
        "select * from values (date'2024-01-07', 1.0D), (date'2024-01-08', 3.0D), (date'2024-01-14', 5.0D),"
        " (null, 9.0D) t(d, v)"
    )
    got = [(str(r["period"]), r["value"]) for r in timeseries.resample_mean(df, "d", "v", "weekly").orderBy("period").collect()]
    assert got == [("2024-01-01", 1.0), ("2024-01-08", 4.0)]


def test_resampling_keeps_the_sum(spark):
    df = spark.range(100).select(
        F.expr("date_add(date'2024-01-01', cast(id * 7 % 60 as int))").alias("d"), (F.col("id") * 1.5).alias("v")
    )
    monthly = timeseries.resample_mean(df, "d", "v", "monthly")
    sizes = df.groupBy(F.trunc("d", "month").alias("period")).count()
    total = monthly.join(sizes, "period").agg(F.sum(F.col("value") * F.col("count"))).first()[0]
    assert total == pytest.approx(sum(i * 1.5 for i in range(100)))


@pytest.mark.parametrize("few", [True, False])
def test_trend_equals_polyfit(spark, few):
    values = list(np.random.default_rng(1).normal(size=40).cumsum())
    slope, start = np.polyfit(range(40), values, 1)
    got = timeseries.linear_trend(_series(spark, values), ["t"], "v", few).orderBy("t").collect()
    assert [r["fitted"] for r in got] == pytest.approx([start + slope * i for i in range(40)])


def test_flat_trend_counts_as_decreasing(spark):
    got = timeseries.trend_summary(_series(spark, [2.0] * 5), ["t"], "v", True).first()
    assert got["trend"] == "Decreasing" and (got["start"], got["end"]) == (0, 4)
    assert timeseries.trend_summary(_series(spark, [1.0, 2.0]), ["t"], "v").first()["trend"] == "Increasing"


@pytest.mark.parametrize("few", [True, False])
def test_moving_average_equals_rolling(spark, few):
    values = [1.0, None, 3.0, 8.0, None, None, 2.0]
    got = timeseries.moving_average(_series(spark, values), ["t"], "v", 2, few).orderBy("t").collect()
    want = pd.Series(values, dtype=float).rolling(2, min_periods=1).mean()
    assert [r["smoothed"] for r in got] == [None if w != w else w for w in want]


def test_no_smoothing(spark):
    got = timeseries.moving_average(_series(spark, [1.0, 5.0]), ["t"], "v", 0).orderBy("t").collect()
    assert [r["smoothed"] for r in got] == [1.0, 5.0]


def _decompose(values, period):
    x = np.array(values)
    half = period // 2
    weights = np.array([0.5] + [1.0] * (period - 1) + [0.5]) if period % 2 == 0 else np.ones(period)
    weights = weights / period
    trend = np.full(len(x), np.nan)
    for i in range(half, len(x) - half):
        trend[i] = weights @ x[i - half : i + half + 1]
    means = np.array([np.nanmean((x - trend)[k::period]) for k in range(period)])
    season = (means - means.mean())[np.arange(len(x)) % period]
    return trend, season


@pytest.mark.parametrize("grain,few", [("quarterly", True), ("daily", False), ("monthly", True), ("yearly", True)])
def test_decomposition(spark, grain, few):
    rng = np.random.default_rng(2)
    period = timeseries.SEASONS[grain]
    values = [float(10 + i * 0.3 + 4 * np.sin(2 * np.pi * i / period) + rng.normal()) for i in range(60)]
    got = timeseries.seasonal_decompose(_series(spark, values), ["t"], "v", grain, few).orderBy("t").toPandas()
    trend, season = _decompose(values, period)
    assert np.allclose(got["trend"].astype(float), trend, equal_nan=True)
    assert np.allclose(got["seasonal"].astype(float), season)
    inner = got.dropna()
    assert np.allclose(inner["observed"], inner["trend"] + inner["seasonal"] + inner["residual"])


def test_short_series_has_no_parts(spark):
    got = timeseries.seasonal_decompose(_series(spark, [1.0] * 7), ["t"], "v", "quarterly", True)
    assert got.count() == 7
    assert got.where("trend is not null or seasonal is not null or residual is not null").count() == 0


def test_histogram_closes_the_last_bin(spark):
    got = distributions.histogram(_series(spark, [0.0, 1.0, 2.0, 10.0, None]), "v", 5).orderBy("bin").collect()
    assert [r["count"] for r in got] == [2, 1, 0, 0, 1]


def test_histogram_of_one_value(spark):
    got = distributions.histogram(_series(spark, [3.0, 3.0]), "v", 4).orderBy("bin").collect()
    assert [r["count"] for r in got] == [2, 0, 0, 0]


def test_density_equals_the_full_sum(spark):
    values = np.random.default_rng(4).lognormal(size=300)
    got = distributions.density(_series(spark, [float(v) for v in values]), "v", 50).orderBy("point").toPandas()
    width = values.std(ddof=1) * len(values) ** -0.2
    grid = np.linspace(values.min(), values.max(), 50)
    want = np.exp(-0.5 * ((grid[:, None] - values) / width) ** 2).sum(axis=1) / (len(values) * width * np.sqrt(2 * np.pi))
    assert np.allclose(got["x"], grid) and np.allclose(got["density"], want, atol=1e-12)


def test_correlation_is_pairwise_complete(spark):
    frame = pd.DataFrame({"a": [1.0, 2.0, 3.0, None, 5.0], "b": [2.0, 1.0, None, 4.0, 9.0], "c": [1.0, 0.0, 2.0, 5.0, 4.0]})
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "a double, b double, c double")
    want = frame.corr()
    for r in distributions.correlation_matrix(df, ["a", "b", "c"]).collect():
        assert r["corr"] == pytest.approx(want.loc[r["a"], r["b"]])


def test_box_whiskers_stay_inside_the_fences(spark):
    got = distributions.box_stats(_series(spark, [1.0, 2.0, 3.0, 4.0, 100.0]), ["v"]).first()
    assert (got["whisker_low"], got["whisker_high"], got["outliers"]) == (1.0, 4.0, 1)
    assert (got["q1"], got["median"], got["q3"]) == (2.0, 3.0, 4.0)


def test_hierarchy(spark):
    df = spark.createDataFrame([("x", "p"), ("x", "q"), ("x", "q"), ("y", None)], "a string, b string")
    got = {(r["a"], r["b"], r["level"]): r["count"] for r in distributions.hierarchy_counts(df, "a", "b").collect()}
    assert got == {("x", None, 1): 3, ("x", "p", 2): 1, ("x", "q", 2): 2}


def test_raw_rows_are_ordered_once(spark):
    """The line, and the season's means, read stored rows: no order is computed again."""
    series = _series(spark, [float(i % 5) for i in range(60)])
    for found in (
        timeseries.linear_trend(series, ["t"], "v"),
        timeseries.seasonal_decompose(series, ["t"], "v"),
    ):
        assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
