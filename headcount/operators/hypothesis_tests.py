"""Tests of group differences. Each gives its statistic lazily, in one row.

Nulls in the value or the group are left out, and groups are taken in label
order. `*_test` functions return the statistic; `with_p` variants add the tail
probability and whether it is below 0.05.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headcount.functions.ordering import average_ranks
from headcount.functions.special import chi2_p, f_p, f_tail, t_p, u_p

# Fixed value: the level below which a difference counts.
ALPHA = 0.05
# Levels that the factor with fewer of them may have: the additive fit solves one
# equation for each, and eliminates the other factor.
MAX_LEVELS = 5000


def _only(count: Column, wanted: int, result: Column, what: str) -> Column:
    failure = F.raise_error(F.concat(F.lit(f"{what} needs {wanted} groups, found "), count.cast("string")))
    return F.when(count != wanted, failure.cast("double")).otherwise(result)


def _at_least(count: Column, wanted: int, result: Column, what: str) -> Column:
    failure = F.raise_error(
        F.concat(F.lit(f"{what} needs at least {wanted} groups, found "), count.cast("string"))
    )
    return F.when(count < wanted, failure.cast("double")).otherwise(result)


def _with_p(df: DataFrame, p: Column) -> DataFrame:
    return df.withColumn("p_value", p).withColumn("reject", F.col("p_value") < ALPHA)


def _groups(df: DataFrame, value: str, group: str) -> DataFrame:
    v = F.col(f"`{value}`").cast("double")
    return (
        df.dropna(subset=[value, group])
        .groupBy(F.col(f"`{group}`").alias("g"))
        .agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("var"))
    )


def t_test(df: DataFrame, value: str, group: str) -> DataFrame:
    """Two-sample t with pooled variance: statistic and degrees of freedom.

    One row in each group leaves no freedom, and the statistic is null.
    """
    sides = _groups(df, value, group).agg(
        F.count(F.lit(1)).alias("k"),
        F.min_by(F.struct("n", "mean", "var"), "g").alias("a"),
        F.max_by(F.struct("n", "mean", "var"), "g").alias("b"),
    )
    n1, n2 = F.col("a.n"), F.col("b.n")
    freedom = n1 + n2 - 2
    spread = F.coalesce(F.col("a.var"), F.lit(0.0)) * (n1 - 1) + F.coalesce(
        F.col("b.var"), F.lit(0.0)
    ) * (n2 - 1)
    error = F.sqrt(F.try_divide(spread, freedom) * (F.lit(1.0) / n1 + F.lit(1.0) / n2))
    t = F.try_divide(F.col("a.mean") - F.col("b.mean"), error)
    return sides.select(
        _only(F.col("k"), 2, t, "t-test").alias("statistic"), freedom.cast("bigint").alias("df")
    )


def t_test_p(df: DataFrame, value: str, group: str) -> DataFrame:
    return _with_p(t_test(df, value, group), t_p(F.col("statistic"), F.col("df")))


def _rank_sums(df: DataFrame, value: str, group: str) -> DataFrame:
    ranks = average_ranks(df.select(value, group), value, group)
    return ranks.groupBy("group").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("rank")).alias("ranks"),
        # Each row of a tied value carries its part of t^3 - t.
        F.sum(F.col("n") * (F.col("ties").cast("double") * F.col("ties") - 1)).alias("ties"),
    )


def mann_whitney(df: DataFrame, value: str, group: str) -> DataFrame:
    """U of the first group, and z with tie and continuity correction."""
    sides = _rank_sums(df, value, group).agg(
        F.count(F.lit(1)).alias("k"),
        F.min_by(F.struct("n", "ranks"), "group").alias("a"),
        F.max_by(F.struct("n", "ranks"), "group").alias("b"),
        F.sum("ties").alias("ties"),
    )
    n1, n2 = F.col("a.n").cast("double"), F.col("b.n").cast("double")
    n = n1 + n2
    u1 = F.col("a.ranks") - n1 * (n1 + 1) / 2
    u = F.greatest(u1, n1 * n2 - u1)
    deviation = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = F.try_divide(u - n1 * n2 / 2 - 0.5, deviation)
    return sides.select(
        _only(F.col("k"), 2, u1, "U test").alias("statistic"),
        z.alias("z"),
        F.col("a.n").alias("n1"),
        F.col("b.n").alias("n2"),
        F.col("ties"),
    )


def mann_whitney_p(df: DataFrame, value: str, group: str) -> DataFrame:
    """The two-sided p-value: exact for a small sample without ties, else normal."""
    u = mann_whitney(df, value, group)
    return _with_p(u, u_p(*[F.col(c) for c in ("statistic", "z", "n1", "n2", "ties")]))


def kruskal_wallis(df: DataFrame, value: str, group: str) -> DataFrame:
    """Tie-corrected H and its degrees of freedom."""
    sums = _rank_sums(df, value, group).agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").cast("double").alias("n"),
        F.sum(F.col("ranks") * F.col("ranks") / F.col("n")).alias("squares"),
        F.sum("ties").alias("ties"),
    )
    n = F.col("n")
    h = F.lit(12.0) / (n * (n + 1)) * F.col("squares") - F.lit(3.0) * (n + 1)
    corrected = F.try_divide(h, F.lit(1.0) - F.col("ties") / (n * n * n - n))
    tested = _at_least(F.col("k"), 2, corrected, "H test")
    return sums.select(tested.alias("statistic"), (F.col("k") - 1).alias("df"))


def kruskal_wallis_p(df: DataFrame, value: str, group: str) -> DataFrame:
    return _with_p(kruskal_wallis(df, value, group), chi2_p(F.col("statistic"), F.col("df")))


def one_way_anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """F between the groups and its two degrees of freedom."""
    groups = _groups(df, value, group)
    grand = groups.agg(F.sum(F.col("n") * F.col("mean")) / F.sum("n")).scalar()
    gap = F.col("mean") - F.col("grand")
    sums = groups.withColumn("grand", grand).agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * gap * gap).alias("between"),
        F.sum((F.col("n") - 1) * F.coalesce(F.col("var"), F.lit(0.0))).alias("within"),
    )
    d1, d2 = F.col("k") - 1, F.col("n") - F.col("k")
    f = F.try_divide(F.try_divide(F.col("between"), d1), F.try_divide(F.col("within"), d2))
    tested = _at_least(F.col("k"), 2, f, "ANOVA")
    return sums.select(tested.alias("statistic"), d1.alias("df_between"), d2.alias("df_within"))


def one_way_anova_p(df: DataFrame, value: str, group: str) -> DataFrame:
    tested = one_way_anova(df, value, group)
    return _with_p(tested, f_p(F.col("statistic"), F.col("df_between"), F.col("df_within")))


def _additive(few: np.ndarray, many: np.ndarray, n: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, int]:
    """The weighted fit of two factors over the cells, and its rank.

    The factor with more levels is eliminated: its equations have one unknown each
    once the other is known, so only the factor with fewer levels needs a solve.
    """
    k, m = few.max() + 1, many.max() + 1
    per_many = np.bincount(many, n, m)
    total = np.bincount(many, n * mean, m)
    # Cells in order of the eliminated level; pairs of cells within one level.
    schur = np.diag(np.bincount(few, n, k))
    right = np.bincount(few, n * mean, k) - np.bincount(few, n * (total / per_many)[many], k)
    order = np.argsort(many, kind="stable")
    for cell in np.split(order, np.flatnonzero(np.diff(many[order])) + 1):
        share = n[cell] / np.sqrt(per_many[many[cell[0]]])
        schur[np.ix_(few[cell], few[cell])] -= np.outer(share, share)
    solved, _, rank, _ = np.linalg.lstsq(schur, right, rcond=1e-10)
    own = (total - np.bincount(many, n * solved[few], m)) / per_many
    return solved[few] + own[many], int(rank) + m


def _type_two(cells: pd.DataFrame) -> pd.DataFrame:
    """Effects from the cells' counts, means and inner sums of squares."""
    a, _ = pd.factorize(cells["a"], sort=True)
    b, _ = pd.factorize(cells["b"], sort=True)
    n, mean = cells["n"].to_numpy(float), cells["mean"].to_numpy(float)
    mean = mean - np.average(mean, weights=n)

    def means(level: np.ndarray) -> tuple[np.ndarray, int]:
        fitted = np.bincount(level, n * mean) / np.bincount(level, n)
        return fitted[level], len(fitted)

    fit_a, rank_a = means(a)
    fit_b, rank_b = means(b)
    fit_both, rank_both = _additive(*((a, b) if rank_a <= rank_b else (b, a)), n, mean)
    rows = [
        ("a", float(n @ (fit_both - fit_b) ** 2), rank_both - rank_b),
        ("b", float(n @ (fit_both - fit_a) ** 2), rank_both - rank_a),
        ("a:b", float(n @ (mean - fit_both) ** 2), len(cells) - rank_both),
        ("Residual", float(cells["within"].sum()), int(n.sum()) - len(cells)),
    ]
    table = pd.DataFrame(rows, columns=["term", "sum_sq", "df"])
    residual = table.iloc[3]
    scale = residual["sum_sq"] / residual["df"] if residual["df"] > 0 else float("nan")
    effects = (table["term"] != "Residual") & (table["df"] > 0)
    table["statistic"] = np.where(effects, table["sum_sq"] / table["df"].clip(lower=1) / scale, np.nan)
    table["p_value"] = [
        f_tail(f, d, residual["df"]) if e and f == f else np.nan
        for e, f, d in zip(effects, table["statistic"], table["df"])
    ]
    return table


def two_way_anova_p(df: DataFrame, value: str, a: str, b: str) -> DataFrame:
    """Type II effects of two factors and their interaction, with p-values.

    Spark reduces the table to one row per cell, whose number does not grow with the
    rows; the fit over the cells solves one equation per level of the smaller factor.
    """
    v = F.col(f"`{value}`").cast("double")
    cells = (
        df.dropna(subset=[value, a, b])
        .groupBy(F.col(f"`{a}`").cast("string").alias("a"), F.col(f"`{b}`").cast("string").alias("b"))
        .agg(
            F.count(v).alias("n"),
            F.avg(v).alias("mean"),
            (F.var_pop(v) * F.count(v)).alias("within"),
        )
    )
    levels = cells.agg(F.least(F.count_distinct("a"), F.count_distinct("b"))).scalar()
    text = f"two-way ANOVA takes at most {MAX_LEVELS} levels of the smaller factor"
    failure = F.raise_error(F.lit(text)).cast("boolean")
    cells = cells.where(F.when(levels > MAX_LEVELS, failure).otherwise(F.lit(True)))
    schema = "term string, sum_sq double, df bigint, statistic double, p_value double"
    table = cells.groupBy(F.lit(0).alias("one")).applyInPandas(_type_two, schema)
    return table.select(
        "term",
        "sum_sq",
        "df",
        F.nanvl("statistic", F.lit(None)).alias("statistic"),
        F.nanvl("p_value", F.lit(None)).alias("p_value"),
    ).withColumn("reject", F.col("p_value") < ALPHA)


def two_way_anova(df: DataFrame, value: str, a: str, b: str) -> DataFrame:
    """The same table without the p-values."""
    return two_way_anova_p(df, value, a, b).drop("p_value", "reject")


def significant_effects(table: DataFrame) -> DataFrame:
    return table.where(F.col("reject")).select("term")
