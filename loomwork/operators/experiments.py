"""Analysis of timing experiments and of trace graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

UNKNOWN = -1
# fixed values: histogram edges 1, 2, ... 29
FIRST_EDGE, LAST_EDGE = 1, 29


def pair_times(plain: DataFrame, instrumented: DataFrame) -> DataFrame:
    """(script, time_no_instr, time_instr): left join of two (script, time) tables."""
    return plain.select("script", F.col("time").alias("time_no_instr")).join(
        instrumented.select("script", F.col("time").alias("time_instr")), "script", "left"
    )


def _sound():
    return F.coalesce(F.col("time_instr") > F.col("time_no_instr"), F.lit(False))


def drop_bad_pairs(pairs: DataFrame) -> DataFrame:
    """Keep pairs whose instrumented run was slower; unmatched scripts go too."""
    return pairs.filter(_sound())


def bad_pairs(pairs: DataFrame) -> DataFrame:
    """One row (kept, dropped)."""
    return pairs.agg(
        F.count_if(_sound()).alias("kept"), F.count_if(~_sound()).alias("dropped")
    )


def overhead_ratio(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("ratio", F.try_divide("time_instr", "time_no_instr"))


def ratio_summary(ratios: DataFrame) -> DataFrame:
    """Count, mean and sample deviation of the ratio; times in minutes."""
    spread = []
    for c, name, unit in (
        ("ratio", "ratio", 1), ("time_no_instr", "plain_mins", 60),
        ("time_instr", "instr_mins", 60),
    ):
        spread += [
            (F.avg(c) / unit).alias(f"{name}_mean"),
            (F.stddev_samp(c) / unit).alias(f"{name}_std"),
        ]
    return ratios.agg(F.count(F.lit(1)).alias("scripts"), *spread)


def histogram(ratios: DataFrame, col: str = "ratio") -> DataFrame:
    """(bin, density) over unit-wide bins from 1 to 29, the last one closed.

    Density is relative to the values in range; empty bins have no row.
    """
    value = F.col(col)
    last = LAST_EDGE - FIRST_EDGE - 1
    inside = ratios.filter(value.between(FIRST_EDGE, LAST_EDGE)).select(
        F.least(F.floor(value) - FIRST_EDGE, F.lit(last)).cast("int").alias("bin")
    )
    counts = inside.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total")).withColumn("one", F.lit(1))
    # at most 28 bins: the join is with a single row
    return counts.withColumn("one", F.lit(1)).join(total, "one").select(
        "bin", (F.col("n") / F.col("total")).alias("density")
    )


def trace_graph(calls: DataFrame) -> DataFrame:
    """Nodes (call, label) and edges (dependency to call) of the call graphs."""
    label = F.concat_ws(".", "func_module", "func_name")
    nodes = calls.select(
        "script", F.lit("node").alias("kind"), F.col("call_id").alias("a"),
        F.lit(None).cast("long").alias("b"), label.alias("label"),
    )
    edges = calls.select("script", "call_id", F.explode("dependencies").alias("dep")).filter(
        F.col("dep") != UNKNOWN
    )
    return nodes.unionByName(
        edges.select(
            "script", F.lit("edge").alias("kind"), F.col("dep").alias("a"),
            F.col("call_id").alias("b"), F.lit(None).cast("string").alias("label"),
        )
    )
