"""Figures of merit of a classifier, and the ranking of several."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headcount.functions.ordering import average_ranks


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: accuracy, and precision, recall and F1 of class 1, zero where undefined."""
    y, p = F.col(label), F.col(prediction)
    counts = df.agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.count_if(y == p).cast("double").alias("same"),
        F.count_if((y == 1) & (p == 1)).cast("double").alias("tp"),
        F.count_if(p == 1).cast("double").alias("called"),
        F.count_if(y == 1).cast("double").alias("actual"),
    )

    def ratio(above: Column, below: Column) -> Column:
        return F.coalesce(F.try_divide(above, below), F.lit(0.0))

    tp, called, actual = F.col("tp"), F.col("called"), F.col("actual")
    return counts.select(
        ratio(F.col("same"), F.col("n")).alias("accuracy"),
        ratio(tp, called).alias("precision"),
        ratio(tp, actual).alias("recall"),
        ratio(tp * 2, called + actual).alias("f1"),
    )


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve, from the mean ranks of the scores; exact with ties."""
    ranks = average_ranks(df.select(label, score), score, label)
    positive = F.col("group") == 1
    sums = ranks.agg(
        F.sum(F.when(positive, F.col("n") * F.col("rank"))).alias("ranks"),
        F.sum(F.when(positive, F.col("n"))).cast("double").alias("n1"),
        F.sum(F.when(~positive, F.col("n"))).cast("double").alias("n0"),
    )
    n1, n0 = F.col("n1"), F.col("n0")
    return sums.select(F.try_divide(F.col("ranks") - n1 * (n1 + 1) / 2, n1 * n0).alias("roc_auc"))


def evaluate(df: DataFrame, label: str, prediction: str, score: str) -> DataFrame:
    """The five figures in one row."""
    auc = roc_auc(df, label, score).scalar()
    return classification_metrics(df, label, prediction).withColumn("roc_auc", auc)


def rank_models(results: DataFrame) -> DataFrame:
    """Sort by accuracy, and mark the model with the largest F1 + recall + precision.

    The table has one row per model; the first in the sort order wins a tie.
    """
    total = F.col("f1") + F.col("recall") + F.col("precision")
    scored = results.withColumn("custom_score", total)
    by_score = W.partitionBy(F.lit(0)).orderBy(F.desc("custom_score"), F.desc("accuracy"), "model")
    return scored.withColumn("best", F.row_number().over(by_score) == 1).orderBy(
        F.desc("accuracy"), "model"
    )
