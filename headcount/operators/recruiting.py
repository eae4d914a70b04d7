"""Recruitment funnel and grouped recruiting figures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headcount.functions.text import contains_ci
from headcount.operators.counts import to_long

# Funnel stages in order.
STAGES = ("Requisitions", "Interviewed", "Shortlisted", "Offer Accepted", "Joined")
# Names of the six figures of a duration.
SIX_FIGURES = ("Min", "Mean", "Median", "Max", "Count", "Std Dev")


@dataclass(frozen=True)
class CandidateColumns:
    """Where a candidate table keeps the funnel answers."""

    interviewed: str = "Interviewed or Not"
    shortlisted: str = "Shortlisted or Not"
    offered: str = "Offer Accepted or Not"
    joined: str = "Joined or Dropout"


def _answers(names: CandidateColumns) -> list[Column]:
    return [
        contains_ci(names.interviewed, "Yes"),
        contains_ci(names.shortlisted, "Yes"),
        contains_ci(names.offered, "Yes"),
        contains_ci(names.joined, "Joined"),
    ]


def _reached(names: CandidateColumns) -> list[Column]:
    """For each stage, whether a candidate passed it and all before it."""
    reached, passed = [F.lit(True)], F.lit(True)
    for answer in _answers(names):
        passed = passed & answer
        reached.append(passed)
    return reached


def recruitment_funnel(df: DataFrame, names: CandidateColumns = CandidateColumns()) -> DataFrame:
    """Candidates left at each nested stage, and the rate over the stage before.

    One pass with five conditional counts. The rate is 0 after an empty stage
    and null for the first.
    """
    wide = df.agg(*[F.count_if(r).alias(s) for s, r in zip(STAGES, _reached(names))])
    rows = []
    for i, stage in enumerate(STAGES):
        here, prior = F.col(f"`{stage}`"), F.col(f"`{STAGES[i - 1]}`")
        rate = (
            F.lit(None).cast("double")
            if i == 0
            else F.when(prior > 0, F.bround(here / prior * F.lit(100.0), 2)).otherwise(F.lit(0.0))
        )
        rows.append(
            F.struct(
                F.lit(i).alias("step"), F.lit(stage).alias("stage"), here.alias("count"), rate.alias("rate")
            )
        )
    return wide.select(F.inline(F.array(*rows)))


def with_funnel_flags(
    df: DataFrame, days: str | None = None, names: CandidateColumns = CandidateColumns()
) -> DataFrame:
    """Add what is absent of Interviewed, Offered, Joined, Funnel Stage, aging days.

    Columns of these names that the table already has are kept, unless they are
    the answer columns themselves.
    """
    answers = dict(zip(("Interviewed", "_", "Offered", "Joined"), _answers(names)))
    own = {names.interviewed, names.shortlisted, names.offered, names.joined}
    stage = F.lit(STAGES[0])
    for name, reached in zip(STAGES[1:], _reached(names)[1:]):
        stage = F.when(reached, F.lit(name)).otherwise(stage)
    wanted = {n: answers[n].cast("int") for n in ("Interviewed", "Offered", "Joined")}
    wanted["Funnel Stage"] = stage
    if days is not None:
        wanted["Requisition Aging Days"] = F.col(days)
    return df.withColumns(
        {n: c for n, c in wanted.items() if n not in df.columns or n in own}
    )


def _keys(by: str, compare: str | None) -> list[str]:
    return [by] + ([compare] if compare else [])


def grouped_metric(df: DataFrame, by: str, compare: str | None, metrics: list[Column]) -> DataFrame:
    """Aggregates per one or two keys; rows with a null key are left out."""
    keys = _keys(by, compare)
    return df.dropna(subset=keys).groupBy(*keys).agg(*metrics)


def _six(column: str) -> list[Column]:
    # Durations are whole days: few distinct values per group, so the built-in
    # exact median keeps little state.
    c = F.col(f"`{column}`")
    figures = (F.min(c), F.avg(c), F.median(c), F.max(c), F.count(c), F.stddev_samp(c))
    return [f.alias(n) for f, n in zip(figures, SIX_FIGURES)]


def time_to_hire(
    df: DataFrame,
    by: str,
    compare: str | None = None,
    days: str = "Days",
    names: CandidateColumns = CandidateColumns(),
) -> DataFrame:
    """Days since the requisition of those who joined: six figures per group."""
    return grouped_metric(df.where(contains_ci(names.joined, "Joined")), by, compare, _six(days))


def requisition_aging(
    df: DataFrame, by: str, compare: str | None = None, days: str = "Requisition Aging Days"
) -> DataFrame:
    """Age of all requisitions in days: six figures per group."""
    return grouped_metric(df, by, compare, _six(days))


def total_profiles(df: DataFrame, by: str, compare: str | None = None) -> DataFrame:
    return grouped_metric(df, by, compare, [F.count(F.lit(1)).alias("Total Profiles")])


def interview_ratio(df: DataFrame, by: str, compare: str | None = None) -> DataFrame:
    return grouped_metric(df, by, compare, [F.avg("Interviewed").alias("Interview Ratio")])


def offer_ratio(df: DataFrame, by: str, compare: str | None = None) -> DataFrame:
    return grouped_metric(df, by, compare, [F.avg("Offered").alias("Offer Ratio")])


def join_ratio(df: DataFrame, by: str, compare: str | None = None) -> DataFrame:
    return grouped_metric(df, by, compare, [F.avg("Joined").alias("Join Ratio")])


def source_effectiveness(
    df: DataFrame, by: str = "Source of Hire", compare: str | None = None
) -> DataFrame:
    """Share and number of candidates who joined, by default per source."""
    return grouped_metric(
        df, by, compare, [F.avg("Joined").alias("Effectiveness"), F.count("Joined").alias("Candidates")]
    )


def funnel_by_group(df: DataFrame, by: str, compare: str | None = None) -> DataFrame:
    """Candidates per group and furthest stage reached."""
    keys = [*_keys(by, compare), "Funnel Stage"]
    return df.dropna(subset=keys).groupBy(*[F.col(f"`{k}`") for k in keys]).agg(
        F.count(F.lit(1)).alias("Count")
    )


def stats_long(stats: DataFrame, by: str, compare: str | None = None) -> DataFrame:
    """A table of figures as rows (keys, Metric, Value)."""
    keys = _keys(by, compare)
    rest = [c for c in stats.columns if c not in keys]
    same = stats.select(*keys, *[F.col(f"`{c}`").cast("double").alias(c) for c in rest])
    return to_long(same, keys, "Metric", "Value")
