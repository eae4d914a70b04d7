"""Turnover prediction from the raw table to scored batches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headcount.operators import balance, features, models
from headcount.operators.columns import with_prediction_measures
from headcount.operators.quality import clean, handle_outliers
from headcount.session import cut_lineage


@dataclass(frozen=True)
class Prepared:
    plan: features.FeaturePlan
    train: DataFrame
    test: DataFrame
    strategy: str

    @property
    def columns(self) -> list[str]:
        return self.plan.outputs


def cleaned(
    df: DataFrame,
    as_of: str,
    exclude: tuple[str, ...] = ("DOE",),
    outlier_columns: list[str] | None = None,
    outliers: str = "None",
) -> DataFrame:
    """The raw table with tenure and age, the null policy applied and outliers treated.

    The exit date is left out of the policy: it is missing for all who stay.
    """
    measured = with_prediction_measures(df, as_of)
    kept = clean(measured, [c for c in measured.columns if c not in exclude])
    if outliers == "Remove" and outlier_columns:
        # Each column's fences are a job of their own.
        kept = cut_lineage(kept)
    return handle_outliers(kept, outlier_columns or [], outliers)


def prepare(
    df: DataFrame,
    target: str,
    key: str,
    categorical: list[str],
    numeric: list[str],
    test_pct: int = 20,
    seed: int = 42,
    balanced: bool = True,
) -> Prepared:
    """Encode, scale, split, and balance the training part.

    The steps read the table many times, so it is stored first, and only with the
    columns they need.
    """
    df = cut_lineage(df.select(key, target, *categorical, *numeric))
    plan = features.fit_features(df, categorical, numeric)
    labelled = features.with_target(df, target).where(F.col("label").isNotNull())
    ready = plan.transform(labelled, [key, "label"])
    split = cut_lineage(features.train_test_split(ready, key, test_pct, seed))
    train, test = split.where(~F.col("is_test")), split.where(F.col("is_test"))
    strategy = "none"
    if balanced:
        strategy, train = balance.balance(train, "label", plan.outputs, key, seed)
    # The training rows are read by every model that is trained or tuned.
    return Prepared(
        plan,
        cut_lineage(train.select("label", *plan.outputs)),
        test.select(key, "label", *plan.outputs),
        strategy,
    )


def tune_and_score(
    prepared: Prepared,
    batch: DataFrame,
    name: str,
    trials: int = models.TRIALS,
    seed: int = 42,
    dates: tuple[str, ...] = (),
) -> tuple[models.Tuned, DataFrame]:
    """Tune the chosen model on the balanced training rows and score a batch with it."""
    tuned = models.tune(prepared.train, prepared.columns, "label", name, trials, seed)
    return tuned, models.score_batch(prepared.plan, tuned.model, batch, prepared.columns, dates)
