"""Combined predictions of several fitted candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def majority_vote(votes: DataFrame) -> DataFrame:
    """(row_id, pred): the most frequent prediction per row; ties take the smallest."""
    counts = votes.groupBy("row_id", "pred").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("rank"), F.col("pred").alias("pred")))
    return counts.groupBy("row_id").agg(best["pred"].alias("pred"))


def modal_width(predictions: DataFrame) -> int | None:
    """The number of classes most programs have; ties take the smaller."""
    widths = predictions.filter("proba is not null").groupBy("program").agg(
        F.max(F.size("proba")).alias("width")
    )
    row = (
        widths.groupBy("width").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "width").first()
    )
    return row["width"] if row else None


def mean_proba(predictions: DataFrame) -> DataFrame:
    """(row_id, class, p): mean probabilities per row, scaled to sum 1.

    Programs without probabilities, or with another number of classes than most, are left
    out. The width is one number, so the mean is a single grouped pass over the rows.
    """
    width = modal_width(predictions)
    if width is None:
        return predictions.select(
            "row_id", F.lit(0).alias("class"), F.lit(0.0).alias("p")
        ).limit(0)
    alike = predictions.filter(F.size("proba") == width)
    means = alike.groupBy("row_id").agg(
        F.array(*[F.avg(F.get("proba", F.lit(i))) for i in range(width)]).alias("p")
    )
    total = F.aggregate("p", F.lit(0.0), lambda s, x: s + x)
    scaled = F.transform("p", lambda x: F.try_divide(x, total))
    return means.select("row_id", F.posexplode(scaled).alias("class", "p"))
