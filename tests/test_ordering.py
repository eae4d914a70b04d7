"""The distributed order statistics against plain pandas and numpy."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from headcount.functions import ordering


def _skewed(seed=0, n=3000):
    """One group with most of the rows, one value with a third of them."""
    rng = np.random.default_rng(seed)
    group = np.where(rng.random(n) < 0.8, "hot", rng.choice(list("abc"), n))
    value = np.where(rng.random(n) < 0.33, 5.0, np.round(rng.normal(5, 3, n), 2))
    return pd.DataFrame({"g": group, "v": value, "id": np.arange(n)})


def test_quantiles_equal_numpy_under_skew(spark):
    frame = _skewed()
    df = spark.createDataFrame(frame).repartition(5)
    probs = {"a": 0.0, "b": 0.1, "c": 0.25, "d": 0.5, "e": 0.99, "f": 1.0}
    for row in ordering.quantiles(df, ["g"], "v", probs).collect():
        values = frame.loc[frame.g == row["g"], "v"]
        for name, p in probs.items():
            assert row[name] == pytest.approx(np.quantile(values, p), abs=1e-9)


def test_result_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame(_skewed(1))
    runs = []
    for parts, ranges in ((1, "1"), (8, "8"), (3, "40")):
        spark.conf.set("spark.sql.shuffle.partitions", ranges)
        found = ordering.quantiles(df.repartition(parts), ["g"], "v", {"q": 0.37})
        runs.append({r["g"]: r["q"] for r in found.collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert runs[0] == runs[1] == runs[2]


@pytest.mark.parametrize(("keys", "ranges"), [(2_000_000, 8), (500, 40)])
def test_ranges_split_a_hot_group(spark, monkeypatch, keys, ranges):
    """No range holds a share of the distinct keys far above its part."""
    monkeypatch.setattr(ordering, "RANGE_KEYS", keys)
    df = spark.range(20_000).select(F.lit("hot").alias("g"), F.col("id").alias("v"), F.lit(1).alias("n"))
    key = F.struct("g", "v")
    found = ordering._located(df, key, ordering._cut_points(df, key, df.columns, 8))
    sizes = [r["count"] for r in found.groupBy("_range").count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 3 * 20_000 / ranges


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=40), st.floats(0, 1))
def test_quantile_of_any_list(spark, values, p):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = ordering.quantiles(df, [], "v", {"q": p}).first()["q"]
    assert got == pytest.approx(np.quantile(values, p), abs=1e-9)


def test_running_sum(spark):
    frame = _skewed(2, 500).drop_duplicates(["g", "v"])
    got = ordering.running_sum(spark.createDataFrame(frame), ["g"], ["v"], "id").toPandas()
    frame = frame.sort_values(["g", "v"])
    frame["want"] = frame.groupby("g")["id"].cumsum() - frame["id"]
    merged = got.merge(frame[["id", "want"]], on="id")
    assert (merged["before"] == merged["want"]).all()
    assert (merged["total"] == merged.groupby("g")["id"].transform("sum")).all()


def test_average_ranks_equal_pandas(spark):
    frame = _skewed(3)
    frame["rank"] = frame["v"].rank(method="average")
    want = frame.groupby(["v", "g"])["rank"].agg(["size", "first"])
    for r in ordering.average_ranks(spark.createDataFrame(frame[["v", "g"]]), "v", "g").collect():
        assert tuple(want.loc[(r["value"], r["group"])]) == (r["n"], r["rank"])


def test_positions_and_sliding_across_blocks(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"t": rng.permutation(500), "v": rng.normal(size=500)})
    df = ordering.row_positions(spark.createDataFrame(frame), ["t"])
    got = ordering.sliding(
        df, 6, 2, {"s": lambda w: F.sum("v").over(w), "n": lambda w: F.count("v").over(w)}, block=10
    ).toPandas().sort_values("t")
    v = frame.sort_values("t")["v"].to_numpy()
    assert got["pos"].tolist() == list(range(500)) and set(got["total"]) == {500}
    for i in (0, 1, 5, 9, 10, 11, 250, 498, 499):
        part = v[max(0, i - 6) : i + 3]
        assert got["s"].iloc[i] == pytest.approx(part.sum()) and got["n"].iloc[i] == len(part)


def test_positions_of_few_rows_agree(spark):
    df = spark.createDataFrame([(3,), (1,), (2,)], "t int")
    for few in (True, False):
        got = {r["t"]: (r["pos"], r["total"]) for r in ordering.row_positions(df, ["t"], few).collect()}
        assert got == {1: (0, 3), 2: (1, 3), 3: (2, 3)}


def test_smallest_by_hash(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("g"))
    wanted = spark.createDataFrame([(0, 37), (1, 100)], "g int, k bigint")
    last = {r["g"]: r["last"] for r in ordering.smallest_by_hash(df, "id", 9, ["g"], wanted).collect()}
    hashed = df.withColumn("h", ordering.hash_order("id", 9)).toPandas().sort_values(["h", "id"])
    for g, k in ((0, 37), (1, 100)):
        row = hashed[hashed.g == g].iloc[k - 1]
        assert tuple(last[g]) == (row["h"], row["id"])


def test_copies_of_a_key_stay_together(spark):
    df = spark.range(300).select(F.lit(7).alias("id")).union(spark.range(100, 200))
    wanted = spark.createDataFrame([(50,)], "k bigint")
    last = ordering.smallest_by_hash(df, "id", 1, [], wanted).first()["last"]
    order = F.struct(ordering.hash_order("id", 1).alias("h"), F.col("id"))
    taken = df.where(order <= F.struct(F.lit(last["_hash"]).alias("h"), F.lit(last["_key"]).alias("id")))
    assert taken.where("id = 7").count() in (0, 300) and taken.count() >= 50
