"""Scores of predictions: (label, pred) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def class_scores(preds: DataFrame) -> DataFrame:
    """(class, f1) for every class that occurs as label or prediction.

    The confusion counts are combined first; everything after is one row per class pair.
    """
    confusion = preds.groupBy("label", "pred").agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)
    sides = confusion.select(
        F.inline(
            F.array(
                F.struct(F.col("label").alias("class"), F.col("n").alias("n"), hit.alias("hit")),
                F.struct(F.col("pred").alias("class"), F.col("n").alias("n"),
                         F.lit(0).cast("long").alias("hit")),
            )
        )
    )
    return sides.groupBy("class").agg(
        F.try_divide(2.0 * F.sum("hit"), F.sum("n")).alias("f1")
    )


def macro_f1(preds: DataFrame) -> DataFrame:
    """One row: the unweighted mean of the class scores; 0 when there is nothing to score."""
    return class_scores(preds).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("score"))


def accuracy(preds: DataFrame) -> DataFrame:
    return preds.agg(F.avg((F.col("label") == F.col("pred")).cast("double")).alias("score"))


def r2(preds: DataFrame) -> DataFrame:
    """Coefficient of determination, from sums in one pass (labels centred on a first value)."""
    shift = preds.select(F.col("label").cast("double")).limit(1).first()
    y = F.col("label").cast("double") - F.lit(shift[0] if shift else 0.0)
    error = F.col("label").cast("double") - F.col("pred").cast("double")
    spread = F.sum(y * y) - F.sum(y) * F.sum(y) / F.count(y)
    return preds.agg((1 - F.try_divide(F.sum(error * error), spread)).alias("score"))


def default_score(preds: DataFrame, task: str) -> DataFrame:
    """Accuracy for classification, R2 for regression."""
    return accuracy(preds) if task == "classification" else r2(preds)
