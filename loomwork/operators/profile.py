"""Meta-features of a table: one long table (entity, feature, num, str).

All simple aggregates of all columns come from a single pass. Exact quantiles take two more
passes that never sort the data: a bounded sketch brackets each wanted rank, then only the
rows inside the brackets are counted by value. Domain statistics are counted per (column,
value) with map-side combining.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from loomwork.functions import stats
from loomwork.session import cut_lineage

NUMERIC = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
    T.DecimalType,
)
NOMINAL = (T.StringType, T.BinaryType)
SKETCH_ACCURACY = 20000
# bracket half-widths with the row counts from which they surely hold the wanted rank
BRACKETS = ((2e-4, 60000), (1e-2, 2000))
NOMINAL_SAMPLE_ROWS = 100
#: different values that a rank is looked for among, and parts that a larger bracket is cut into
RANK_ROWS = 1 << 16
RANGES = 1024
#: groups whose bounds are sent to the rows; a shuffle would gather the rows of few groups in few tasks
BROADCAST_GROUPS = 10_000
COLUMN_STATS = (
    "mean", "geometric_mean", "median", "min_zscore", "max_zscore", "zscore", "iqr", "std",
    "max", "min", "count_nonzero", "skew", "kurtosis", "missing",
)


def column_kinds(df: DataFrame, ignore: tuple[str, ...] = ()) -> dict[str, list[str]]:
    """Column names by kind; temporal, array, map and struct columns belong to none."""
    kinds = {"numeric": [], "nominal": [], "boolean": []}
    for field in df.schema.fields:
        if field.name in ignore:
            continue
        if isinstance(field.dataType, NUMERIC):
            kinds["numeric"].append(field.name)
        elif isinstance(field.dataType, NOMINAL):
            kinds["nominal"].append(field.name)
        elif isinstance(field.dataType, T.BooleanType):
            kinds["boolean"].append(field.name)
    return kinds


def _numbers(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """Numeric columns as doubles, NaN turned into null."""
    as_double = {c: F.col(c).cast("double") for c in cols}
    return df.select(
        *by, *[F.when(~F.isnan(v), v).alias(c) for c, v in as_double.items()]
    )


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _unpivot(wide: DataFrame, by: list[str], cells: dict[tuple[str, str], str]) -> DataFrame:
    """Rows (by..., column, stat, value) from one wide row per entity; cells are SQL."""
    text = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    entries = ", ".join(
        f"{text(c)}, {text(s)}, cast({v} as double)" for (c, s), v in cells.items()
    )
    return wide.selectExpr(
        *[_q(k) for k in by], f"stack({len(cells)}, {entries}) as (column, stat, value)"
    )


def _bracketed(
    data: DataFrame, cols: list[str], probs: list[float], by: list[str]
) -> DataFrame:
    """Add to every row the bounds around each wanted rank and a median-like centre.

    Column i gets `__lo_i_j` and `__hi_i_j` for probability j, and `__mid_i`. One pass over
    bounded sketches; without grouping the bounds are a single row of numbers.
    """
    widths = [(p, w) for p in probs for w, _ in BRACKETS]
    wanted = [e for p, w in widths for e in (max(p - w, 0.0), min(p + w, 1.0))]
    accuracy = SKETCH_ACCURACY if probs else 100
    at = ", ".join(f"{v!r}d" for v in [0.0, 0.5, 1.0, *wanted])
    sketched = data.groupBy(*by).agg(
        *[
            F.expr(f"percentile_approx({_q(c)}, array({at}), {accuracy}) as __q_{i}")
            for i, c in enumerate(cols)
        ],
        *[F.expr(f"count({_q(c)}) as __n_{i}") for i, c in enumerate(cols)],
    )
    bounds = []
    for i in range(len(cols)):
        bounds.append(f"__q_{i}[1] as __mid_{i}")
        for j in range(len(probs)):
            # the tightest bracket the row count allows, else the whole range
            for side, name, whole in ((0, "lo", 0), (1, "hi", 2)):
                cases = " ".join(
                    f"when __n_{i} >= {rows} then "
                    f"__q_{i}[{3 + 2 * (j * len(BRACKETS) + k) + side}]"
                    for k, (_, rows) in enumerate(BRACKETS)
                )
                bounds.append(
                    f"case {cases} else __q_{i}[{whole}] end as __{name}_{i}_{j}"
                )
    limits = sketched.selectExpr(*[_q(k) for k in by], *bounds)
    if by:
        limits = cut_lineage(limits)  # sketched once for all passes over the data
        few = limits.count() <= BROADCAST_GROUPS
        return data.join(F.broadcast(limits) if few else limits, by)
    row = limits.first()  # one row of columns * (2 * probabilities + 1) numbers
    return data.select(
        "*", *[F.lit(v).cast("double").alias(name) for name, v in row.asDict().items()]
    )


def _narrowed(values: DataFrame, wanted: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The values near each wanted rank, and the ranks with the rows that are below them.

    `values` has keys, v and rows, `wanted` keys, below and lower (a rank). The range of values is
    cut into RANGES equal parts, and the parts that hold the ranks lower and lower + 1 stay.
    """
    span = values.groupBy(*keys).agg(F.min("v").alias("__lo"), F.max("v").alias("__hi"))
    share = F.try_divide(F.col("v") - F.col("__lo"), F.col("__hi") - F.col("__lo"))
    part = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * RANGES), F.lit(RANGES - 1))
    cut = values.join(span, keys).withColumn("__part", part).drop("__lo", "__hi")
    order = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)
    counts = cut.groupBy(*keys, "__part").agg(F.sum("rows").alias("__rows"))
    counts = counts.withColumn("__upto", F.sum("__rows").over(order)).join(wanted, keys)
    end = F.col("below") + F.col("__upto")
    start = end - F.col("__rows")
    kept = counts.filter((end > F.col("lower")) & (start <= F.col("lower") + 1)).withColumn("__start", start)
    kept = cut_lineage(kept)
    near = cut.join(kept.select(*keys, "__part"), [*keys, "__part"], "left_semi").drop("__part")
    below = kept.groupBy(*keys, "lower").agg(F.min("__start").alias("below"))
    return cut_lineage(near), below.select(*keys, "below", "lower")


def _ranks(
    placed: DataFrame, totals: DataFrame, cols: list[str], probs: list[float], by: list[str],
    rank_rows: int = RANK_ROWS,
) -> DataFrame:
    """Interpolated quantiles from rows inside the brackets and counts `__b_i_j` below them.

    The different values inside the brackets are stored. A bracket with more than `rank_rows` of
    them is narrowed by counts of value ranges until no rank is looked for among more.
    """
    pairs = [(i, j) for i in range(len(cols)) for j in range(len(probs))]
    keys = [_q(k) for k in by]
    hits = ", ".join(
        f"case when {_q(cols[i])} between __lo_{i}_{j} and __hi_{i}_{j} "
        f"then named_struct('i', {i}, 'j', {j}, 'v', {_q(cols[i])}) end"
        for i, j in pairs
    )
    inside = placed.selectExpr(
        *keys, f"explode(array_compact(array({hits}))) as cell"
    ).groupBy(*by, "cell").agg(F.count(F.lit(1)).alias("rows"))
    counts = ", ".join(f"{i}, {j}, __b_{i}_{j}, __n_{i}" for i, j in pairs)
    below = totals.selectExpr(
        *keys, f"stack({len(pairs)}, {counts}) as (i, j, below, n)"
    )
    values = cut_lineage(inside.select(*by, "cell.i", "cell.j", "cell.v", "rows"))
    place = [*by, "i", "j"]

    def most() -> int:
        return values.groupBy(*place).count().agg(F.max("count")).first()[0] or 0

    many, before = most(), None
    if many > rank_rows:
        each = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("j") + 1)
        below = cut_lineage(below)
        total = below.select(*place, "n")
        wanted = below.select(*place, "below", F.floor(each * (F.col("n") - 1)).alias("lower"))
        while many > rank_rows and many != before:
            values, wanted = _narrowed(values, wanted, place)
            many, before = most(), many
        below = wanted.join(total, place).select(*place, "below", "n")
    order = Window.partitionBy(*place).orderBy("v")
    ranked = values.select(
        "*",
        F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.lead("v").over(order).alias("next"),
    )
    prob = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("j") + 1)
    name = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("i") + 1)
    target = prob * (F.col("n") - 1)
    lower = F.floor(target)
    located = ranked.join(below, [*by, "i", "j"]).select(
        *by, name.alias("column"), prob.alias("prob"), "v", "next",
        target.alias("target"), lower.alias("lower"),
        (F.col("below") + F.col("upto") - F.col("rows")).alias("start"),
        (F.col("below") + F.col("upto")).alias("end"),
    ).filter((F.col("start") <= F.col("lower")) & (F.col("lower") < F.col("end")))
    after = F.when(F.col("lower") + 1 < F.col("end"), F.col("v")).otherwise(
        F.coalesce("next", "v")
    )
    value = F.col("v") + (F.col("target") - F.col("lower")) * (after - F.col("v"))
    return located.select(*by, "column", "prob", value.alias("value"))


def _rank_counts(cols: list[str], probs: list[float]) -> list[Column]:
    return [
        F.expr(f"count_if({_q(c)} < __lo_{i}_{j}) as __b_{i}_{j}")
        for i, c in enumerate(cols)
        for j in range(len(probs))
    ] + [F.expr(f"count({_q(c)}) as __n_{i}") for i, c in enumerate(cols)]


def exact_quantiles(
    df: DataFrame, cols: list[str], probs: list[float], by: list[str] | None = None,
    rank_rows: int = RANK_ROWS,
) -> DataFrame:
    """Exact linearly interpolated quantiles: rows (by..., column, prob, value).

    The sketch gives bounds around each wanted rank; rows below a bracket are only counted,
    rows inside it are counted by value. A frequent value is one row after map-side combining.
    """
    by = by or []
    placed = _bracketed(_numbers(df, by, cols), cols, probs, by)
    totals = placed.groupBy(*by).agg(*_rank_counts(cols, probs))
    return _ranks(placed, totals, cols, probs, by, rank_rows)


def numeric_column_stats(
    df: DataFrame,
    cols: list[str] | None = None,
    by: list[str] | None = None,
    nulls: str = "omit",
    quantiles: str = "exact",
) -> DataFrame:
    """Per-column statistics: rows (by..., column, stat, value).

    nulls='omit' leaves missing cells out; nulls='propagate' makes every statistic of a column
    with a missing cell NaN, the way plain array reductions do. quantiles: 'exact', 'approx'
    or 'skip'.

    Moments are sums of powers around the sketched median. A median is within one standard
    deviation of the mean, so the sums do not cancel, and they compile to far less code than
    separate deviation, skewness and kurtosis aggregates.
    """
    by = by or []
    cols = cols or column_kinds(df, tuple(by))["numeric"]
    probs = [0.25, 0.5, 0.75]
    data = _numbers(df, by, cols)
    placed = _bracketed(data, cols, probs if quantiles == "exact" else [], by)
    aggregates = [F.count(F.lit(1)).alias("__rows")]
    aggregates += _rank_counts(cols, probs if quantiles == "exact" else [])
    means, centred, cells = [], [], {}
    for i, c in enumerate(cols):
        v, d = _q(c), f"({_q(c)} - __mid_{i})"
        sums = {
            "ln": f"sum(case when {v} > 0 then ln({v}) end)",
            "min": f"min({v})", "max": f"max({v})", "nz": f"count_if({v} <> 0)",
            "mid": f"first(__mid_{i})",
            **{f"s{k}": f"sum({' * '.join([d] * k)})" for k in range(1, 5)},
        }
        if quantiles == "approx":
            at = ", ".join(f"{p!r}d" for p in probs)
            sums["pct"] = f"percentile_approx({v}, array({at}), {SKETCH_ACCURACY})"
        aggregates += [F.expr(f"{e} as __{k}_{i}") for k, e in sums.items()]
        means += [f"try_divide(__s{k}_{i}, __n_{i}) as __a{k}_{i}" for k in range(1, 5)]
        a1, a2, a3, a4 = (f"__a{k}_{i}" for k in range(1, 5))
        centred += [
            f"greatest({a2} - {a1} * {a1}, 0.0d) as __v_{i}",
            f"{a3} - 3 * {a1} * {a2} + 2 * {a1} * {a1} * {a1} as __m3_{i}",
            f"{a4} - 4 * {a1} * {a3} + 6 * {a1} * {a1} * {a2} "
            f"- 3 * {a1} * {a1} * {a1} * {a1} as __m4_{i}",
        ]
        lo, hi, var = f"__min_{i}", f"__max_{i}", f"__v_{i}"
        avg, std = f"(__mid_{i} + {a1})", f"sqrt({var})"
        values = {
            "mean": avg,
            "geometric_mean": f"case when {lo} < 0 then double('NaN') when {lo} = 0 then 0.0d "
                              f"else exp(try_divide(__ln_{i}, __n_{i})) end",
            "min_zscore": f"try_divide({lo} - {avg}, {std})",
            "max_zscore": f"try_divide({hi} - {avg}, {std})",
            "zscore": f"case when {std} > 0 then 0.0d end",
            "std": std,
            "max": hi,
            "min": lo,
            # an all-zero column does not enter the average over columns
            "count_nonzero": f"nullif(__nz_{i}, 0)",
            "skew": f"coalesce(try_divide(__m3_{i}, {var} * {std}), 0.0d)",
            "kurtosis": f"coalesce(try_divide(__m4_{i}, {var} * {var}) - 3, -3.0d)",
        }
        if quantiles == "approx":
            values["median"] = f"__pct_{i}[1]"
            values["iqr"] = f"__pct_{i}[2] - __pct_{i}[0]"
        missing = f"(1 - try_divide(double(__n_{i}), __rows))"
        for stat, value in values.items():
            # zscore and count_nonzero keep their null: those columns leave the average
            known = f"case when __n_{i} > 0 then {value} end"
            if nulls == "propagate" and stat != "count_nonzero":
                known = f"case when {missing} > 0 then double('NaN') else {known} end"
            cells[c, stat] = known
        cells[c, "missing"] = missing
    wide = placed.groupBy(*by).agg(*aggregates)
    derived = wide.selectExpr("*", *means).selectExpr("*", *centred)
    result = _unpivot(derived, by, cells)
    if quantiles == "exact":
        spread = _ranks(placed, wide, cols, probs, by).groupBy(*by, "column").agg(
            *[
                F.max(F.when(F.col("prob") == p, F.col("value"))).alias(a)
                for a, p in zip(("q1", "q2", "q3"), probs)
            ]
        )
        pairs = F.array(
            F.struct(F.lit("median").alias("stat"), F.col("q2").alias("value")),
            F.struct(F.lit("iqr").alias("stat"), (F.col("q3") - F.col("q1")).alias("value")),
        )
        exact = spread.select(*by, "column", F.inline(pairs))
        if nulls == "propagate":
            gaps = result.filter((F.col("stat") == "missing") & (F.col("value") > 0))
            exact = exact.join(
                gaps.select(*by, "column", F.lit(True).alias("gap")), [*by, "column"], "left"
            ).select(
                *by, "column", "stat",
                F.when(F.col("gap"), F.lit(math.nan)).otherwise(F.col("value")).alias("value"),
            )
        result = result.unionByName(exact)
    return result.filter(F.col("value").isNotNull())


def _entity(by: list[str]) -> Column:
    if not by:
        return F.lit("table")
    return F.concat_ws("|", *[F.col(c).cast("string") for c in by])


def _features(long: DataFrame, by: list[str], name: Column, value: Column) -> DataFrame:
    return long.select(
        _entity(by).alias("entity"), name.alias("feature"), value.cast("double").alias("num"),
        F.lit(None).cast("string").alias("str"),
    )


def numeric_features(
    df: DataFrame,
    cols: list[str] | None = None,
    by: list[str] | None = None,
    nulls: str = "omit",
    quantiles: str = "exact",
    compat: bool = True,
) -> DataFrame:
    """`colwise_avg_<stat>`: the per-column statistics averaged over columns.

    compat adds the collapsed key `colwise_avg_zscore_stats` older feature tables carry.
    """
    by = by or []
    long = numeric_column_stats(df, cols, by, nulls, quantiles)
    mean = long.groupBy(*by, "stat").agg(F.avg("value").alias("value"))
    names = F.concat(F.lit("colwise_avg_"), F.col("stat"))
    result = _features(mean, by, names, F.col("value"))
    if compat:
        result = result.unionByName(
            _features(
                mean.filter("stat = 'zscore'"), by, F.lit("colwise_avg_zscore_stats"),
                F.col("value"),
            )
        )
    return result


def boolean_features(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """Largest, smallest and mean fraction of true over the boolean columns."""
    by = by or []
    wide = df.groupBy(*by).agg(
        *[F.avg(F.col(c).cast("double")).alias(f"__t_{i}") for i, c in enumerate(cols)]
    )
    names = [f"__t_{i}" for i in range(len(cols))]
    fractions, total = f"array({', '.join(names)})", " + ".join(names)
    cells = {
        ("", "colwise_max_fraction_true"): f"array_max({fractions})",
        ("", "colwise_min_fraction_true"): f"array_min({fractions})",
        ("", "colwise_avg_fraction_true"): f"({total}) / {len(cols)}",
    }
    return _features(_unpivot(wide, by, cells), by, F.col("stat"), F.col("value"))


def hash_sample(df: DataFrame, key: list[str], rows: int, seed: int) -> DataFrame:
    """The `rows` rows with the smallest key hash: a reproducible sample, taken as a top-n."""
    return df.orderBy(_key_hash(key, seed), *key).limit(rows)


def _key_hash(key: list[str], seed: int) -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def nominal_column_stats(
    df: DataFrame, cols: list[str], by: list[str] | None = None, approx: bool = False
) -> DataFrame:
    """Domain size, value frequencies and missing share per string column."""
    by = by or []
    missing = _unpivot(
        df.groupBy(*by).agg(
            *[F.avg(F.col(c).isNull().cast("double")).alias(f"__m_{i}")
              for i, c in enumerate(cols)],
            *(
                [F.approx_count_distinct(c).alias(f"__d_{i}") for i, c in enumerate(cols)]
                if approx else []
            ),
        ),
        by,
        {
            **{(c, "colwise_missing_nominal"): f"__m_{i}" for i, c in enumerate(cols)},
            **(
                {(c, "size_domain_nominal"): f"__d_{i}" for i, c in enumerate(cols)}
                if approx else {}
            ),
        },
    )
    if approx:
        return missing
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in cols]
    )
    counts = (
        df.select(*by, F.inline(cells)).filter(F.col("v").isNotNull())
        .groupBy(*by, "column", "v").agg(F.count(F.lit(1)).alias("n"))
    )
    wide = counts.groupBy(*by, "column").agg(
        F.count(F.lit(1)).alias("size"), F.avg("n").alias("mean"), F.min("n").alias("low"),
        F.max("n").alias("high"),
    )
    entries = F.array(
        *[
            F.struct(F.lit(s).alias("stat"), F.col(v).cast("double").alias("value"))
            for s, v in (
                ("size_domain_nominal", "size"), ("mean_freq_nominal", "mean"),
                ("min_freq_nominal", "low"), ("max_freq_nominal", "high"),
            )
        ]
    )
    return missing.unionByName(wide.select(*by, "column", F.inline(entries)))


def nominal_features(
    df: DataFrame,
    cols: list[str],
    by: list[str] | None = None,
    approx: bool = False,
    cap: int | None = None,
    cap_key: list[str] | None = None,
    seed: int = 0,
) -> DataFrame:
    """`colwise_avg_<stat>` over the string columns; exact unless a sample cap is asked for."""
    by = by or []
    sampled = None
    if cap is not None:
        df = hash_sample(df, cap_key or cols, cap, seed)
        sampled = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    long = nominal_column_stats(df, cols, by, approx)
    mean = long.groupBy(*by, "stat").agg(F.avg("value").alias("value"))
    result = _features(
        mean, by, F.concat(F.lit("colwise_avg_"), F.col("stat")), F.col("value")
    )
    if sampled is not None:
        result = result.unionByName(
            _features(sampled, by, F.lit("num_rows_sampled"), F.col("n"))
        )
    return result


DISTRIBUTIONS = {
    "dist_norm": (stats.norm_pdf, stats.norm_cdf),
    "dist_chi2": (stats.chi2_pdf, stats.chi2_cdf),
    "dist_expon": (stats.expon_pdf, stats.expon_cdf),
    # shape 1 is the exponential curve
    "dist_gamma": (stats.expon_pdf, stats.expon_cdf),
}


def distribution_features(
    df: DataFrame,
    cols: list[str],
    by: list[str] | None = None,
    curves: tuple[str, ...] = ("pdf", "cdf"),
    cell_share: float | None = None,
    cell_key: list[str] | None = None,
    seed: int = 0,
) -> DataFrame:
    """Mean density and mean cumulative probability over all cells of the matrix.

    Sums per column are taken in one pass and divided by the number of cells. With `cell_share`
    that share of the cells is used, chosen by a hash of the row's key and the column's place,
    for any size of table.
    """
    by = by or []
    data = _numbers(df, by, cols)
    sizes = {}
    if cell_share is not None:
        cells = [F.col(c).cast("double") for c in cols]
        flat = df.select(
            *by, _key_hash(cell_key or cols, seed).alias("__h"), F.posexplode(F.array(*cells))
        )
        slot = F.conv(
            F.substring(F.md5(F.concat_ws("|", "__h", F.col("pos").cast("string"))), 1, 8), 16, 10
        ).cast("long")
        kept = flat.filter(slot < int(cell_share * (1 << 32))).withColumnRenamed("col", "cell")
        data, cols = _numbers(kept, by, ["cell"]), ["cell"]
        sizes["matrixwise_numeric_distribution_num_rows_sampled"] = "__cells"
    totals = {}
    for name, (pdf, cdf) in DISTRIBUTIONS.items():
        for curve, fn in (("pdf", pdf), ("cdf", cdf)):
            if curve in curves:
                totals[f"matrixwise_avg_{name}_{curve}"] = [fn(F.col(c)) for c in cols]
    # curves first as plain columns, so that each Python value is computed once
    curves_wide = data.select(
        *by, *cols,
        *[v.alias(f"__{k}_{i}") for k, vs in totals.items() for i, v in enumerate(vs)],
    )
    wide = curves_wide.groupBy(*by).agg(
        *[
            reduce(lambda a, b: a + b,
                   [F.coalesce(F.sum(f"__{k}_{i}"), F.lit(0.0)) for i in range(len(cols))])
            .alias(k)
            for k in totals
        ],
        reduce(lambda a, b: a + b, [F.count(c) for c in cols]).alias("__cells"),
    )
    cells = {("", k): f"try_divide({k}, __cells)" for k in totals}
    cells.update({("", k): v for k, v in sizes.items()})
    return _features(_unpivot(wide, by, cells), by, F.col("stat"), F.col("value"))


def correlation_features(
    df: DataFrame,
    cols: list[str],
    by: list[str] | None = None,
    extremes: bool = False,
    tile_rows: int = 1000,
) -> DataFrame:
    """Mean Pearson correlation between rows; with `extremes` the largest and smallest too.

    With unit rows z the correlation of two rows is their product, so the mean over all pairs
    is (|sum z|^2 - n) / (n (n - 1)): one aggregate for any number of rows. The extremes need
    every pair of different rows and are computed by pairs of tiles, only when asked for. A row
    that is constant or has a missing value has no correlation and makes the results NaN.
    """
    by = by or []
    if len(cols) < 2:
        empty = df.select(*by, F.lit("").alias("stat"), F.lit(0.0).alias("value")).limit(0)
        return _features(empty, by, F.col("stat"), F.col("value"))
    x = F.array(*[F.col(c).cast("double") for c in cols])
    mean = F.aggregate("__x", F.lit(0.0), lambda a, v: a + v) / len(cols)
    centred = _numbers(df, by, cols).select(*by, x.alias("__x")).withColumn("__mean", mean)
    centred = centred.withColumn("__d", F.transform("__x", lambda v: v - F.col("__mean")))
    norm = F.sqrt(F.aggregate("__d", F.lit(0.0), lambda a, v: a + v * v))
    units = centred.withColumn("__norm", norm).select(
        *by, F.transform("__d", lambda v: F.try_divide(v, F.col("__norm"))).alias("__z"),
        (F.col("__norm") > 0).alias("__ok"),
    )
    usable = F.coalesce(F.col("__ok"), F.lit(False)) & ~F.isnan(F.col("__z")[0])
    units = units.withColumn("__ok", F.coalesce(usable, F.lit(False)))
    sums = units.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min("__ok").alias("ok"),
        *[F.sum(F.col("__z")[i]).alias(f"s{i}") for i in range(len(cols))],
    ).filter("n > 1")
    square = reduce(lambda a, b: a + b, [F.col(f"s{i}") * F.col(f"s{i}") for i in range(len(cols))])
    average = (square - F.col("n")) / (F.col("n") * (F.col("n") - 1))
    value = F.when(F.col("ok"), average).otherwise(F.lit(float("nan")))
    long = sums.select(*by, F.lit("matrixwise_avg_corr").alias("stat"), value.alias("value"))
    if extremes:
        long = long.unionByName(_extreme_correlations(units, sums.select(*by, "ok"), by, tile_rows))
    return _features(long, by, F.col("stat"), F.col("value"))


def _extreme_correlations(
    units: DataFrame, entities: DataFrame, by: list[str], tile_rows: int
) -> DataFrame:
    """(by..., stat, value) of the largest and smallest correlation, from pairs of tiles."""
    # equal rows are one row with a number of copies, so that no tile grows with them
    rows = units.filter("__ok").groupBy(*by, "__z").agg(F.count(F.lit(1)).alias("__copies"))
    tiles = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("__t"))
    entity = F.struct(*by) if by else F.struct(F.lit(0).alias("__all"))
    rows = rows.withColumn("__e", entity).drop(*by)
    tiles = tiles.select(entity.alias("__e"), "__t")
    own = F.pmod(F.xxhash64("__z"), F.col("__t")).cast("int")
    placed = rows.join(tiles, "__e").withColumn("__own", own).select(
        "__e", "__z", "__copies", "__own",
        F.explode(F.sequence(F.lit(0), F.col("__t") - 1)).alias("__with"),
    )
    placed = placed.select(
        "__e", "__z", "__copies", "__own",
        F.least("__own", "__with").alias("__a"), F.greatest("__own", "__with").alias("__b"),
    )

    def pair(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.stack(pdf["__z"].to_numpy())
        a = (pdf["__own"] == key[-2]).to_numpy()
        if key[-2] == key[-1]:
            found = (z @ z.T)[np.triu_indices(len(z), 1)]
        else:
            found = (z[a] @ z[~a].T).ravel()
        if (pdf["__copies"] > 1).any():
            found = np.append(found, 1.0)
        low, high = (found.min(), found.max()) if found.size else (None, None)
        return pd.DataFrame({"__k": [pdf["__k"].iloc[0]], "low": [low], "high": [high]})

    named = placed.withColumn("__k", F.to_json("__e"))
    found = named.drop("__e").groupBy("__k", "__a", "__b").applyInPandas(
        pair, "__k string, low double, high double"
    ).groupBy("__k").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    known = entities.withColumn("__k", F.to_json(entity)).join(found, "__k", "left")
    nan = F.lit(float("nan"))
    entries = F.array(
        *[
            F.struct(
                F.lit(f"matrixwise_{k}_corr").alias("stat"),
                F.when(F.col("ok"), F.col(v)).otherwise(nan).alias("value"),
            )
            for k, v in (("max", "high"), ("min", "low"))
        ]
    )
    return known.select(*by, F.inline(entries))


def shape_features(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Row count, columns per kind and the argument type."""
    by = by or []
    # kind letters as in array type codes
    letters = {"numeric": "f", "nominal": "O", "boolean": "b"}
    kinds = column_kinds(df, tuple(by))
    counts = {
        ("", f"count_column_type_{letters[k]}"): str(len(c)) for k, c in kinds.items() if c
    }
    counts["", "num_rows"] = "__n"
    wide = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 0")
    numbers = _features(_unpivot(wide, by, counts), by, F.col("stat"), F.col("value"))
    label = wide.select(
        _entity(by).alias("entity"), F.lit("arg_type").alias("feature"),
        F.lit(None).cast("double").alias("num"), F.lit(type(df).__name__).alias("str"),
    )
    return numbers.unionByName(label)


def as_table(data) -> DataFrame | None:
    """Coerce a DataFrame, a grouped DataFrame or (DataFrame, column) to a plain table."""
    if isinstance(data, DataFrame):
        return data
    if isinstance(data, tuple) and len(data) == 2:
        return data[0].select(data[1])
    base = getattr(data, "_df", None)  # GroupedData keeps the table it groups
    return base if isinstance(base, DataFrame) else None


def profile(
    data,
    by: list[str] | None = None,
    nulls: str = "omit",
    quantiles: str = "exact",
    nominal_cap: int | None = None,
    cell_share: float | None = None,
    extremes: bool = False,
    keep_bad: bool = False,
) -> DataFrame:
    """All features of a table, or of each group of it when `by` is given.

    A kind without columns contributes nothing; features that cannot be computed are left out
    (keep_bad=True keeps NaN and infinite values).
    """
    df = as_table(data)
    by = by or []
    if df is None:
        raise TypeError(f"cannot profile {type(data).__name__}")
    kinds = column_kinds(df, tuple(by))
    parts = [shape_features(df, by)]
    if kinds["numeric"]:
        parts += [
            numeric_features(df, kinds["numeric"], by, nulls, quantiles),
            distribution_features(df, kinds["numeric"], by, cell_share=cell_share),
            correlation_features(df, kinds["numeric"], by, extremes),
        ]
    if kinds["nominal"]:
        parts.append(nominal_features(df, kinds["nominal"], by, cap=nominal_cap))
    if kinds["boolean"]:
        parts.append(boolean_features(df, kinds["boolean"], by))
    result = reduce(DataFrame.unionByName, parts)
    present = F.col("num").isNotNull() | F.col("str").isNotNull()
    if not keep_bad:
        present &= F.col("num").isNull() | (
            ~F.isnan("num") & (F.abs("num") < F.lit(math.inf))
        )
    return result.filter(present)


def unhandled_features(spark, kind: str) -> DataFrame:
    """The feature rows of an input no profile exists for."""
    rows = [("table", "arg_type", None, kind), ("table", "unhandled", 1.0, None)]
    return spark.createDataFrame(rows, "entity string, feature string, num double, str string")


def sparse_column_stats(entries: DataFrame, rows: int, width: int) -> DataFrame:
    """Column statistics of a sparse matrix given as (row, idx, value) entries.

    Absent entries are zeros: power sums per index are divided by the number of rows.
    Columns without any entry count as all-zero columns of the `width` columns.
    """
    v = F.col("value")
    sums = entries.groupBy("idx").agg(
        F.sum(v).alias("s1"), F.sum(v * v).alias("s2"), F.sum(v * v * v).alias("s3"),
        F.count_if((v != 0) | F.isnan(v)).alias("nonzero"),
        F.count_if(F.isnan(v)).alias("nan"),
    )
    n = F.lit(float(rows))
    mean = F.col("s1") / n
    var = F.greatest(F.col("s2") / n - mean * mean, F.lit(0.0))
    third = F.col("s3") / n - 3 * mean * var - mean * mean * mean
    return sums.select(
        "idx", mean.alias("mean"), F.sqrt(var).alias("std"),
        F.try_divide(third, var * F.sqrt(var)).alias("skew"),
        F.col("nonzero"), (F.col("nan") / n).alias("missing"),
    )


def sparse_features(entries: DataFrame, rows: int, width: int) -> DataFrame:
    """Table-level features of a sparse matrix; `colwise_avg_sparse_spread_stats` is the
    collapsed key older feature tables carry (it equals the skew)."""
    columns = sparse_column_stats(entries, rows, width)
    w = F.lit(float(width))
    wide = columns.agg(
        (F.sum("mean") / w).alias("mean"), (F.sum("std") / w).alias("std"),
        # an all-zero column has no skew and makes the mean undefined
        F.when(F.count("skew") == width, F.avg("skew")).alias("skew"),
        F.avg(F.nullif("nonzero", F.lit(0))).alias("count_nonzero"),
        (F.sum("missing") / w).alias("missing"),
    )
    cells = {
        ("", f"colwise_avg_{s}"): s
        for s in ("mean", "std", "skew", "count_nonzero", "missing")
    }
    cells["", "colwise_avg_sparse_spread_stats"] = "skew"
    long = _unpivot(wide, [], cells).filter(F.col("value").isNotNull())
    return _features(long, [], F.col("stat"), F.col("value"))


def bootstrap_profile(
    df: DataFrame, key: list[str], n: int, fraction: float, seed: int = 0, **options
) -> DataFrame:
    """Profile of n samples without replacement; numbers averaged, other features taken once.

    Every row draws its n samples from a hash of its key, so all samples are profiled by one
    grouped job instead of n separate ones.
    """
    space = 1 << 30
    picks = F.filter(
        F.sequence(F.lit(1), F.lit(n)),
        lambda i: F.pmod(F.xxhash64(F.lit(seed), i, *key), F.lit(space))
        < F.lit(int(fraction * space)),
    )
    samples = df.select("*", F.explode(picks).alias("__sample"))
    parts = profile(samples, by=["__sample"], **options)
    combined = parts.groupBy("feature").agg(
        F.avg("num").alias("num"), F.min("str").alias("str")
    )
    totals = df.agg(
        F.count(F.lit(1)).cast("double").alias("n")
    ).select(
        F.inline(
            F.array(
                F.struct(F.lit("num_rows").alias("feature"), F.col("n").alias("num"),
                         F.lit(None).cast("string").alias("str")),
                F.struct(F.lit("sample_params").alias("feature"),
                         F.lit(None).cast("double").alias("num"),
                         F.lit(f"{n},{fraction}").alias("str")),
            )
        )
    )
    return (
        combined.filter("feature <> 'num_rows'").unionByName(totals)
        .select(F.lit("table").alias("entity"), "feature", "num", "str")
    )


class ProfileCache:
    """Keeps one persisted profile per data set id."""

    def __init__(self, **options):
        self._options = options
        self._known: dict[str, DataFrame] = {}

    def get(self, dataset_id: str, data=None) -> DataFrame | None:
        if dataset_id not in self._known and data is not None:
            rows = profile(data, **self._options).withColumn("entity", F.lit(dataset_id))
            self._known[dataset_id] = rows.persist()
        return self._known.get(dataset_id)

    def clear(self) -> None:
        for rows in self._known.values():
            rows.unpersist()
        self._known.clear()
