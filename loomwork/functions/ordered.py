"""Ordered computations that stay parallel inside one key.

A plain window sends every row of a key to one task. Here the rows of a key are cut into
chunks of consecutive order values, so one task sees at most `chunk_rows` rows of a key (the
order column holds distinct integers per key). Chunk summaries, one row per chunk, carry the
state across chunks. Keys and order values must not be null.

Where order values may lie far apart, `ranked` first replaces them by places in a global sort: then
a key has about one chunk for each `chunk_rows` of its rows, whatever its values are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomwork.session import cut_lineage

CHUNK_ROWS = 1 << 16
_CHUNK = "__chunk"


def ranked(
    df: DataFrame, keys: list[str], order: str, name: str, whole: bool = False
) -> DataFrame:
    """Add places by (keys, order), stored: consecutive inside each range of the sort.

    Ranges begin at multiples of 2^33, so chunks of a power of two up to that hold consecutive
    rows only, and one key has rows / chunk_rows of them, and one more for each range it touches.

    Finding the ranges takes a pass over df of its own. whole=True deals the rows by key instead:
    for a df that is dear to make, and keys whose rows one task held before.
    """
    dealt = df.repartition(*keys) if whole else df.repartitionByRange(*keys, order)
    placed = dealt.sortWithinPartitions(*keys, order)
    return cut_lineage(placed.withColumn(name, F.monotonically_increasing_id()))


def _chunked(df: DataFrame, order: str, chunk_rows: int) -> DataFrame:
    return df.withColumn(_CHUNK, F.expr(f"`{order}` div {chunk_rows}"))


def _before(keys: list[str]):
    return (
        Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    )


def running(
    df: DataFrame,
    keys: list[str],
    order: str,
    sums: dict[str, Column] | None = None,
    minima: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    chunk_rows: int = CHUNK_ROWS,
    exclusive: bool = False,
) -> DataFrame:
    """Add running sums, minima and last non-null values, including the current row.

    exclusive=True leaves the current row out. Nulls do not contribute; a running sum with no value so far is 0.
    """
    sums, minima, lasts = sums or {}, minima or {}, lasts or {}
    base = _chunked(df, order, chunk_rows)
    inside = (
        Window.partitionBy(*keys, _CHUNK)
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1 if exclusive else Window.currentRow)
    )
    summary = base.groupBy(*keys, _CHUNK).agg(
        *[F.sum(c).alias(f"__s_{n}") for n, c in sums.items()],
        *[F.min(c).alias(f"__m_{n}") for n, c in minima.items()],
        *[
            F.max(F.when(c.isNotNull(), F.struct(F.col(order).alias("at"), c.alias("v"))))["v"]
            .alias(f"__l_{n}")
            for n, c in lasts.items()
        ],
    )
    before = _before(keys)
    carried = summary.select(
        *keys,
        _CHUNK,
        *[F.sum(f"__s_{n}").over(before).alias(f"__s_{n}") for n in sums],
        *[F.min(f"__m_{n}").over(before).alias(f"__m_{n}") for n in minima],
        *[
            F.last(f"__l_{n}", ignorenulls=True).over(before).alias(f"__l_{n}")
            for n in lasts
        ],
    )
    inner = base.withColumns(
        {
            **{f"__i_{n}": F.sum(c).over(inside) for n, c in sums.items()},
            **{f"__i_{n}": F.min(c).over(inside) for n, c in minima.items()},
            **{
                f"__i_{n}": F.last(c, ignorenulls=True).over(inside)
                for n, c in lasts.items()
            },
        }
    )
    joined = inner.join(carried, [*keys, _CHUNK], "left")
    zero = F.lit(0)
    return joined.select(
        *df.columns,
        *[
            (F.coalesce(f"__i_{n}", zero) + F.coalesce(f"__s_{n}", zero)).alias(n)
            for n in sums
        ],
        *[F.least(f"__i_{n}", f"__m_{n}").alias(n) for n in minima],
        *[F.coalesce(f"__i_{n}", f"__l_{n}").alias(n) for n in lasts],
    )


def previous(
    df: DataFrame,
    keys: list[str],
    order: str,
    value: Column,
    k: int,
    name: str,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add an array with the up to k values before each row, nearest last."""
    if k < 1:
        return df.withColumn(name, F.array().cast("array<string>"))
    base = _chunked(df, order, chunk_rows).withColumn("__v", value)
    window = Window.partitionBy(*keys, _CHUNK).orderBy(order)
    near = window.rowsBetween(-k, -1)
    inner = base.withColumns(
        {
            "__near": F.collect_list("__v").over(near),
            "__last": F.lead(F.lit(1)).over(window).isNull(),
            "__tail": F.collect_list("__v").over(window.rowsBetween(1 - k, 0)),
        }
    )
    tails = inner.filter("__last").select(*keys, _CHUNK, "__tail")
    reach = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(-k, -1)
    carried = tails.select(
        *keys, _CHUNK, F.flatten(F.collect_list("__tail").over(reach)).alias("__carry")
    )
    both = F.concat(F.coalesce("__carry", F.array().cast(carried.schema["__carry"].dataType)),
                    F.col("__near"))
    joined = inner.join(carried, [*keys, _CHUNK], "left").withColumn("__both", both)
    start = F.greatest(F.size("__both") - k + 1, F.lit(1))
    return joined.select(*df.columns, F.slice("__both", start, F.lit(k)).alias(name))


def dense_index(df: DataFrame, order: list, name: str, first: int = 0) -> DataFrame:
    """Number all rows of df from `first` in the given order, without a one-task window.

    Rows are range partitioned and stored once; the only further pass adds up one row
    count per partition.
    """
    ordered = (
        df.withColumn("__tie", F.monotonically_increasing_id())
        .orderBy(*order, "__tie")
        .drop("__tie")
        .withColumn("__at", F.monotonically_increasing_id())
    )
    stored = cut_lineage(ordered).withColumns(
        {
            "__part": F.shiftright("__at", 33),
            "__row": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)),
        }
    )
    sizes = stored.groupBy("__part").agg((F.max("__row") + 1).alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start")
    )
    return stored.join(starts, "__part").select(
        *df.columns, (F.col("__row") + F.col("__start") + F.lit(first)).alias(name)
    )
