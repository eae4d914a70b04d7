import math

import numpy as np
import pandas as pd
import pytest

from headcount.functions import special
from headcount.operators import hypothesis_tests as tests


def _groups(spark, **groups):
    rows = [(g, None if v is None else float(v)) for g, values in groups.items() for v in values]
    return spark.createDataFrame(rows, "g string, v double")


# Published critical values: tail probability at the tabulated point.
@pytest.mark.parametrize(
    "tail,want",
    [
        (special.t_tail(2.228, 10), 0.05),
        (special.t_tail(12.706, 1), 0.05),
        (special.t_tail(1.960, 1e6), 0.05),
        (special.t_tail(3.169, 10), 0.01),
        (special.f_tail(4.10, 2, 10), 0.05),
        (special.f_tail(2.37, 4, 1e9), 0.05),
        (special.chi2_tail(3.841, 1), 0.05),
        (special.chi2_tail(5.991, 2), 0.05),
        (special.chi2_tail(18.307, 10), 0.05),
        (special.chi2_tail(0.103, 2), 0.95),
        (special.normal_tail(1.959964), 0.05),
    ],
)
def test_tails_at_critical_values(tail, want):
    assert tail == pytest.approx(want, rel=5e-3)


def test_tail_identities():
    assert special.beta_inc(2, 3, 0.4) + special.beta_inc(3, 2, 0.6) == pytest.approx(1)
    assert special.beta_inc(1, 1, 0.3) == pytest.approx(0.3)
    assert special.gamma_tail(1, 2.0) == pytest.approx(math.exp(-2))
    assert special.f_tail(0.0, 3, 5) == 1.0
    assert special.chi2_tail(1e4, 1) == pytest.approx(0.0)


def test_exact_rank_sum_counts():
    # Of the 20 ways to choose 3 of 6 ranks one gives the largest sum, one the smallest.
    assert special.exact_u_tail(0, 3, 3) == pytest.approx(2 / 20)
    assert special.exact_u_tail(1, 3, 3) == pytest.approx(4 / 20)
    assert special.exact_u_tail(4.5, 3, 3) == 1.0
    assert special.exact_u_tail(0, 1, 4) == pytest.approx(2 / 5)


def test_t_test_by_hand(spark):
    df = _groups(spark, b=[4, 5, 6, 7], a=[1, 2, 3, None])
    got = tests.t_test_p(df, "v", "g").first()
    x, y = np.array([1.0, 2, 3]), np.array([4.0, 5, 6, 7])
    pooled = (2 * x.var(ddof=1) + 3 * y.var(ddof=1)) / 5
    want = (x.mean() - y.mean()) / math.sqrt(pooled * (1 / 3 + 1 / 4))
    assert got["statistic"] == pytest.approx(want) and got["df"] == 5
    assert got["reject"] is True and 0 < got["p_value"] < 0.05


@pytest.mark.parametrize("test", [tests.t_test, tests.mann_whitney])
def test_two_groups_are_needed(spark, test):
    with pytest.raises(Exception, match="needs 2 groups, found 3"):
        test(_groups(spark, a=[1, 2], b=[2, 3], c=[4, 5]), "v", "g").collect()
    with pytest.raises(Exception, match="needs 2 groups, found 1"):
        test(_groups(spark, a=[1, 2]), "v", "g").collect()


def test_u_of_small_samples_is_exact(spark):
    got = tests.mann_whitney_p(_groups(spark, a=[1, 2, 3], b=[4, 5, 6]), "v", "g").first()
    assert got["statistic"] == 0.0 and got["p_value"] == pytest.approx(0.1)


def test_u_with_ties_is_normal(spark):
    a, b = [1, 2, 2, 3, 3, 3], [2, 3, 4, 4, 5]
    got = tests.mann_whitney_p(_groups(spark, a=a, b=b), "v", "g").first()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert got["statistic"] == u
    n, ties = 11, sum(t**3 - t for t in pd.Series(a + b).value_counts())
    deviation = math.sqrt(30 / 12 * (n + 1 - ties / (n * (n - 1))))
    z = (max(u, 30 - u) - 15 - 0.5) / deviation
    assert got["z"] == pytest.approx(z)
    assert got["p_value"] == pytest.approx(math.erfc(z / math.sqrt(2)))


def test_kruskal_by_hand(spark):
    groups = {"a": [1, 2, 2], "b": [2, 3, 4], "c": [5, 6]}
    got = tests.kruskal_wallis_p(_groups(spark, **groups), "v", "g").first()
    frame = pd.DataFrame([(g, v) for g, vs in groups.items() for v in vs], columns=["g", "v"])
    ranks = frame["v"].rank().groupby(frame["g"]).agg(["sum", "size"])
    h = 12 / (8 * 9) * (ranks["sum"] ** 2 / ranks["size"]).sum() - 3 * 9
    h /= 1 - (3**3 - 3) / (8**3 - 8)
    assert got["statistic"] == pytest.approx(h) and got["df"] == 2
    assert got["p_value"] == pytest.approx(math.exp(-h / 2))


def test_anova_of_two_groups_is_t_squared(spark):
    df = _groups(spark, a=[1, 5, 2, 8], b=[4, 9, 6])
    f = tests.one_way_anova_p(df, "v", "g").first()
    t = tests.t_test_p(df, "v", "g").first()
    assert f["statistic"] == pytest.approx(t["statistic"] ** 2)
    assert f["p_value"] == pytest.approx(t["p_value"])
    assert (f["df_between"], f["df_within"]) == (1, 5)


def _residual(frame, factors, interaction=False):
    parts = [np.ones((len(frame), 1))] + [pd.get_dummies(frame[f]).to_numpy(float) for f in factors]
    if interaction:
        parts.append(pd.get_dummies(frame["a"] + frame["b"]).to_numpy(float))
    design = np.hstack(parts)
    fit = np.linalg.lstsq(design, frame["v"], rcond=None)[0]
    return float(((frame["v"] - design @ fit) ** 2).sum()), np.linalg.matrix_rank(design)


@pytest.mark.parametrize("drop_cell", [False, True])
def test_type_two_equals_least_squares(spark, drop_cell):
    rng = np.random.default_rng(6)
    frame = pd.DataFrame({"a": rng.choice(list("xyz"), 200), "b": rng.choice(list("pqrs"), 200, p=[0.5, 0.3, 0.1, 0.1])})
    frame["v"] = rng.normal(size=200) + (frame["a"] == "x") * 2 + (frame["b"] == "q")
    if drop_cell:
        frame = frame[~((frame["a"] == "z") & (frame["b"] == "s"))]
    got = {r["term"]: r for r in tests.two_way_anova_p(spark.createDataFrame(frame), "v", "a", "b").collect()}
    (only_a, ra), (only_b, rb) = _residual(frame, ["a"]), _residual(frame, ["b"])
    both, rab = _residual(frame, ["a", "b"])
    full, rank = _residual(frame, ["a", "b"], interaction=True)
    want = {
        "a": (only_b - both, rab - rb),
        "b": (only_a - both, rab - ra),
        "a:b": (both - full, rank - rab),
        "Residual": (full, len(frame) - rank),
    }
    for term, (squares, freedom) in want.items():
        assert got[term]["sum_sq"] == pytest.approx(squares) and got[term]["df"] == freedom
    assert got["Residual"]["statistic"] is None and got["Residual"]["p_value"] is None
    found = tests.significant_effects(tests.two_way_anova_p(spark.createDataFrame(frame), "v", "a", "b"))
    assert {r["term"] for r in found.collect()} >= {"a", "b"}


def test_two_way_guard(spark):
    df = spark.range(6000).selectExpr("cast(id as string) a", "cast(id as string) b", "id * 1.0D v")
    with pytest.raises(Exception, match="at most 5000 levels"):
        tests.two_way_anova(df, "v", "a", "b").collect()


def test_two_way_with_many_levels_on_one_side(spark):
    """The larger factor is eliminated, so its levels cost nothing."""
    df = spark.range(36_000).selectExpr(
        "cast(id % 6000 as string) a",
        "cast(id div 6000 % 3 as string) b",
        "(id div 6000 % 3) + (id * 37 % 11) / 10.0D v",
    )
    got = {r["term"]: r for r in tests.two_way_anova(df, "v", "a", "b").collect()}
    assert got["a"]["df"] == 5999 and got["b"]["df"] == 2 and got["b"]["statistic"] > 100


@pytest.mark.parametrize("test", [tests.kruskal_wallis, tests.one_way_anova])
def test_one_group_is_not_enough(spark, test):
    with pytest.raises(Exception, match="at least 2 groups, found 1"):
        test(_groups(spark, a=[1, 2]), "v", "g").collect()


def test_two_rows_leave_no_freedom(spark):
    got = tests.t_test_p(_groups(spark, a=[1], b=[2]), "v", "g").first()
    assert got["statistic"] is None and got["p_value"] is None and got["df"] == 0


def test_many_groups_rank_like_few(spark):
    frame = pd.DataFrame({"g": [f"g{i % 40:02d}" for i in range(400)], "v": [float(i * 7 % 50) for i in range(400)]})
    got = tests.kruskal_wallis(spark.createDataFrame(frame), "v", "g").first()
    ranks = frame["v"].rank().groupby(frame["g"]).agg(["sum", "size"])
    h = 12 / (400 * 401) * (ranks["sum"] ** 2 / ranks["size"]).sum() - 3 * 401
    h /= 1 - sum(t**3 - t for t in frame["v"].value_counts()) / (400**3 - 400)
    assert got["statistic"] == pytest.approx(h) and got["df"] == 39
