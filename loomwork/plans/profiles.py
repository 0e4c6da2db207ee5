"""Profiling queries (group M)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomwork.functions.stats import neat
from loomwork.operators import profile as p
from loomwork.plans.common import Registry, table

registry = Registry()

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
PART_STRINGS = ["p_name", "p_brand", "p_type"]


def _sql_numeric_stats(source: str, cols: list[str]) -> str:
    """Per-column statistics from plain moments, one row per (column, stat)."""
    parts = []
    for c in cols:
        parts.append(f"""
select '{c}' as "column", unnest(['mean','geometric_mean','median','min_zscore','max_zscore',
  'zscore','iqr','std','max','min','count_nonzero','skew','kurtosis','missing']) as stat,
  unnest([m, case when lo < 0 then null when lo = 0 then 0 else g end, q2, (lo - m) / nullif(s, 0),
  (hi - m) / nullif(s, 0), case when s > 0 then 0.0 end, q3 - q1, s, hi, lo, nullif(nz, 0),
  coalesce(m3 / nullif(s * s * s, 0), 0), coalesce(m4 / nullif(s * s * s * s, 0) - 3, -3),
  miss]) as v
from (
  select any_value(a.m) as m, any_value(a.s) as s, min(x) as lo, max(x) as hi,
    exp(avg(case when x > 0 then ln(x) end)) as g,
    quantile_cont(x, 0.25) as q1, quantile_cont(x, 0.5) as q2, quantile_cont(x, 0.75) as q3,
    sum((x <> 0)::int)::double as nz, avg((x - a.m) ** 3) as m3, avg((x - a.m) ** 4) as m4,
    avg((x is null)::int::double) as miss
  from (select {c}::double as x from {source}) t,
    (select avg({c}::double) as m, stddev_pop({c}::double) as s from {source}) a
)""")
    return "\nunion all\n".join(parts)


_COLUMN_SQL = _sql_numeric_stats("lineitem", LINE_NUMBERS)


@registry.add(
    "profile_numeric_columns",
    f'select "column", stat, round(v, 4) + 0.0 as value from ({_COLUMN_SQL}) where v is not null',
)
def profile_numeric_columns(spark: SparkSession, sf: str) -> DataFrame:
    rows = p.numeric_column_stats(
        table(spark, sf, "lineitem", heavy=True), LINE_NUMBERS
    )
    return rows.select("column", "stat", neat(F.col("value"), 4).alias("value"))


_NUMERIC_SQL = f"""
with t as (select stat, avg(v) as v from ({_COLUMN_SQL}) where v is not null group by stat)
select 'table' as entity, 'colwise_avg_' || stat as feature, round(v, 4) + 0.0 as num from t
union all
select 'table', 'colwise_avg_zscore_stats', round(v, 4) + 0.0 from t where stat = 'zscore'
"""


@registry.add("profile_numeric_features", _NUMERIC_SQL)
def profile_numeric_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = p.numeric_features(
        table(spark, sf, "lineitem", heavy=True), LINE_NUMBERS
    )
    return rows.select("entity", "feature", neat(F.col("num"), 4).alias("num"))


@registry.add(
    "profile_numeric_by_group",
    """
select l_returnflag || '|' || l_linestatus as entity, 'colwise_avg_' || stat as feature,
  round(avg(v), 5) + 0.0 as num
from (
  select l_returnflag, l_linestatus, unnest(['mean','median','std','iqr','missing']) as stat,
    unnest([avg(x), quantile_cont(x, 0.5), stddev_pop(x),
      quantile_cont(x, 0.75) - quantile_cont(x, 0.25), avg((x is null)::int::double)]) as v
  from (select l_returnflag, l_linestatus, unnest(['q', 'p']) as c,
      unnest([l_quantity, l_extendedprice]) as x from lineitem)
  group by l_returnflag, l_linestatus, c)
group by all
""",
)
def profile_numeric_by_group(spark: SparkSession, sf: str) -> DataFrame:
    rows = p.numeric_features(
        table(spark, sf, "lineitem", heavy=True), ["l_quantity", "l_extendedprice"],
        by=["l_returnflag", "l_linestatus"], compat=False,
    )
    wanted = [f"colwise_avg_{s}" for s in ("mean", "median", "std", "iqr", "missing")]
    return rows.filter(F.col("feature").isin(wanted)).select(
        "entity", "feature", neat(F.col("num"), 5).alias("num")
    )


@registry.add(
    "profile_shape",
    """
select 'table' as entity, feature, n::double as num from (
  select 'num_rows' as feature, count(*) as n from lineitem
  union all select 'count_column_type_f', 8 union all select 'count_column_type_O', 2)
""",
)
def profile_shape(spark: SparkSession, sf: str) -> DataFrame:
    return (
        p.shape_features(table(spark, sf, "lineitem"))
        .filter("num is not null").select("entity", "feature", "num")
    )


@registry.add(
    "profile_boolean",
    """
with t as (select avg((l_returnflag = 'R')::int::double) as a,
  avg((l_linestatus = 'O')::int::double) as b, avg((l_quantity > 25)::int::double) as c
  from lineitem)
select 'table' as entity, 'colwise_max_fraction_true' as feature,
  round(greatest(a, b, c), 6) as num from t
union all select 'table', 'colwise_min_fraction_true', round(least(a, b, c), 6) from t
union all select 'table', 'colwise_avg_fraction_true', round((a + b + c) / 3, 6) from t
""",
)
def profile_boolean(spark: SparkSession, sf: str) -> DataFrame:
    flags = table(spark, sf, "lineitem").select(
        (F.col("l_returnflag") == "R").alias("a"), (F.col("l_linestatus") == "O").alias("b"),
        (F.col("l_quantity") > 25).alias("c"),
    )
    rows = p.boolean_features(flags, ["a", "b", "c"])
    return rows.select("entity", "feature", neat(F.col("num")).alias("num"))


_NOMINAL_SQL = "\nunion all\n".join(
    f"""select '{c}' as c, unnest(['size_domain_nominal','mean_freq_nominal','min_freq_nominal',
  'max_freq_nominal','colwise_missing_nominal']) as stat,
  unnest([count(*)::double, avg(n), min(n)::double, max(n)::double,
    (select avg(({c} is null)::int::double) from part)]) as v
from (select {c}, count(*) as n from part where {c} is not null group by {c})"""
    for c in PART_STRINGS
)


@registry.add(
    "profile_nominal",
    f"""select 'table' as entity, 'colwise_avg_' || stat as feature, round(avg(v), 6) as num
from ({_NOMINAL_SQL}) group by stat""",
)
def profile_nominal(spark: SparkSession, sf: str) -> DataFrame:
    rows = p.nominal_features(table(spark, sf, "part"), PART_STRINGS)
    return rows.select("entity", "feature", neat(F.col("num")).alias("num"))


_SAMPLED_PART = "(select * from part order by md5('0|' || p_partkey), p_partkey limit 100)"


@registry.add(
    "profile_nominal_sampled",
    f"""select 'table' as entity, 'colwise_avg_' || stat as feature, round(avg(v), 6) as num
from ({_NOMINAL_SQL.replace("from part", "from " + _SAMPLED_PART)}) group by stat
union all select 'table', 'num_rows_sampled', count(*)::double from {_SAMPLED_PART}""",
)
def profile_nominal_sampled(spark: SparkSession, sf: str) -> DataFrame:
    rows = p.nominal_features(
        table(spark, sf, "part"), PART_STRINGS, cap=p.NOMINAL_SAMPLE_ROWS,
        cap_key=["p_partkey"],
    )
    return rows.select("entity", "feature", neat(F.col("num")).alias("num"))


_CURVES = {
    "dist_norm_pdf": "exp(-x * x / 2) / sqrt(2 * pi())",
    "dist_chi2_pdf": "case when x > 0 then exp(-x / 2) / sqrt(2 * pi() * x) else 0 end",
    "dist_expon_pdf": "case when x < 0 then 0 else exp(-x) end",
    "dist_gamma_pdf": "case when x < 0 then 0 else exp(-x) end",
}


@registry.add(
    "profile_distributions_density",
    "\nunion all\n".join(
        f"""select 'table' as entity, 'matrixwise_avg_{k}' as feature, round(avg({e}), 8) + 0.0 as num
from (select unnest([l_quantity / 10, l_extendedprice / 10000, l_linenumber::double]) as x
  from lineitem)"""
        for k, e in _CURVES.items()
    ),
)
def profile_distributions_density(spark: SparkSession, sf: str) -> DataFrame:
    rows = p.distribution_features(_scaled(spark, sf), ["a", "b", "c"], curves=("pdf",))
    return rows.select("entity", "feature", neat(F.col("num"), 8).alias("num"))


def _scaled(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        (F.col("l_quantity") / 10).alias("a"), (F.col("l_extendedprice") / 10000).alias("b"),
        F.col("l_linenumber").cast("double").alias("c"),
    )


# erf by Simpson's rule on 200 intervals, independent of the library's erf
_ERF = """(2 / sqrt(pi()) * {z} / 600 * list_sum(list_transform(range(0, 201),
  lambda k: (case when k = 0 or k = 200 then 1 when k % 2 = 1 then 4 else 2 end)
    * exp(0 - power(({z}) * k / 200, 2)))))"""


@registry.add(
    "profile_distributions_cumulative",
    f"""
with v as (select x, count(*) as n from (
    select unnest([l_quantity / 10, l_linenumber::double]) as x from lineitem) group by x),
c as (select n, unnest(['norm', 'chi2', 'expon', 'gamma']) as k,
  unnest([(1 + {_ERF.format(z='(x / sqrt(2))')}) / 2, {_ERF.format(z='sqrt(x / 2)')},
    1 - exp(-x), 1 - exp(-x)]) as y from v)
select 'table' as entity, 'matrixwise_avg_dist_' || k || '_cdf' as feature,
  round(sum(y * n) / sum(n), 6) as num from c group by k
""",
)
def profile_distributions_cumulative(spark: SparkSession, sf: str) -> DataFrame:
    rows = p.distribution_features(_scaled(spark, sf), ["a", "c"], curves=("cdf",))
    return rows.select("entity", "feature", neat(F.col("num"), 6).alias("num"))


_SAMPLED_ERF = """(case when {z} > 6 then 1.0 else %s end)""" % _ERF


@registry.add(
    "profile_distributions_sampled",
    f"""
with r as (select md5('0|' || l_orderkey || '|' || l_linenumber) as h,
    [l_orderkey::double, l_partkey::double, l_suppkey::double, l_quantity / 10] as v from lineitem),
c as (select h, unnest(v) as x, generate_subscripts(v, 1) - 1 as pos from r),
s as (select x from c
  where ('0x' || substr(md5(h || '|' || pos), 1, 8))::bigint < (0.05 * 4294967296)::bigint),
f as (select x, unnest(['norm_pdf', 'chi2_pdf', 'expon_pdf', 'gamma_pdf', 'norm_cdf', 'chi2_cdf',
    'expon_cdf', 'gamma_cdf']) as k,
  unnest([exp(-x * x / 2) / sqrt(2 * pi()), exp(-x / 2) / sqrt(2 * pi() * x), exp(-x), exp(-x),
    (1 + {_SAMPLED_ERF.format(z='(x / sqrt(2))')}) / 2, {_SAMPLED_ERF.format(z='sqrt(x / 2)')},
    1 - exp(-x), 1 - exp(-x)]) as y from s)
select 'table' as entity, 'matrixwise_avg_dist_' || k as feature, round(avg(y), 6) as num
from f group by k
union all
select 'table', 'matrixwise_numeric_distribution_num_rows_sampled', count(*)::double from s
""",
)
def profile_distributions_sampled(spark: SparkSession, sf: str) -> DataFrame:
    data = table(spark, sf, "lineitem").withColumn("tens", F.col("l_quantity") / 10)
    cols = ["l_orderkey", "l_partkey", "l_suppkey", "tens"]
    return p.distribution_features(
        data, cols, cell_share=0.05, cell_key=["l_orderkey", "l_linenumber"]
    ).select("entity", "feature", neat(F.col("num")).alias("num"))


@registry.add(
    "profile_row_correlation",
    """
with r as (select c_nationkey as g, c_custkey as id,
    [c_custkey::double, c_nationkey::double, c_acctbal, c_acctbal * (c_custkey % 7)] as v
  from customer),
z as (select g, id, list_transform(v, lambda x: x - list_avg(v)) as d from r),
n as (select g, id, d, sqrt(list_sum(list_transform(d, lambda x: x * x))) as len from z),
c as (select a.g, list_dot_product(a.d, b.d) / (a.len * b.len) as r
  from n a join n b on a.g = b.g and a.id < b.id)
select g::varchar as entity, unnest(['matrixwise_max_corr', 'matrixwise_min_corr',
  'matrixwise_avg_corr']) as feature,
  round(unnest([max(r), min(r), avg(r)]), 5) + 0.0 as num from c group by g
""",
)
def profile_row_correlation(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "customer").select(
        "c_custkey", "c_nationkey", F.col("c_nationkey").alias("nation"), "c_acctbal",
        (F.col("c_acctbal") * (F.col("c_custkey") % 7)).alias("mixed"),
    )
    rows = p.correlation_features(
        base, ["c_custkey", "nation", "c_acctbal", "mixed"], by=["c_nationkey"], extremes=True
    )
    return rows.select("entity", "feature", neat(F.col("num"), 5).alias("num"))


@registry.add(
    "profile_sparse",
    """
with e as (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1
    as idx from embeddings),
s as (select idx, case when abs(v) >= 0.1 then v else 0 end as v from e),
c as (select idx, avg(v) as m, avg(v * v) - avg(v) * avg(v) as var,
    avg(v * v * v) as m3, sum((v <> 0)::int) as nz from s group by idx)
select idx, round(m, 8) + 0.0 as mean, round(sqrt(var), 8) as std,
  round((m3 - 3 * m * var - m * m * m) / (var * sqrt(var)), 6) + 0.0 as skew,
  nz as nonzero, 0.0 as missing
from c
""",
)
def profile_sparse(spark: SparkSession, sf: str) -> DataFrame:
    entries, rows = _sparse_entries(spark, sf)
    stats = p.sparse_column_stats(entries, rows, 64)
    return stats.select(
        F.col("idx").cast("long").alias("idx"), neat(F.col("mean"), 8).alias("mean"),
        neat(F.col("std"), 8).alias("std"), neat(F.col("skew")).alias("skew"), "nonzero",
        "missing",
    )


def _sparse_entries(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    vectors = table(spark, sf, "embeddings")
    cells = vectors.select(
        F.col("vec_id").alias("row"), F.posexplode("embedding").alias("idx", "v")
    )
    entries = cells.filter(F.abs(F.col("v").cast("double")) >= 0.1).select(
        "row", "idx", F.col("v").cast("double").alias("value")
    )
    return entries, vectors.count()


@registry.add(
    "profile_sparse_features",
    """
with e as (select unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as idx
    from embeddings),
s as (select idx, case when abs(v) >= 0.1 then v else 0 end as v from e),
c as (select idx, avg(v) as m, avg(v * v) - avg(v) * avg(v) as var,
    avg(v * v * v) as m3, sum((v <> 0)::int) as nz from s group by idx),
f as (select avg(m) as m, avg(sqrt(var)) as sd,
    avg((m3 - 3 * m * var - m * m * m) / (var * sqrt(var))) as sk, avg(nz) as nz from c)
select 'table' as entity, 'colwise_avg_' || unnest(['mean', 'std', 'skew',
  'sparse_spread_stats', 'count_nonzero', 'missing']) as feature,
  round(unnest([m, sd, sk, sk, nz, 0.0]), 6) + 0.0 as num from f
""",
)
def profile_sparse_features(spark: SparkSession, sf: str) -> DataFrame:
    entries, rows = _sparse_entries(spark, sf)
    return p.sparse_features(entries, rows, 64).select(
        "entity", "feature", neat(F.col("num")).alias("num")
    )


@registry.add("profile_table")
def profile_table(spark: SparkSession, sf: str) -> DataFrame:
    mixed = table(spark, sf, "part").withColumn("cheap", F.col("p_retailprice") < 1000)
    return p.profile(mixed).select(
        "entity", "feature", neat(F.col("num")).alias("num"), "str"
    )


@registry.add("profile_bootstrap")
def profile_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    rows = p.bootstrap_profile(
        table(spark, sf, "customer"), ["c_custkey"], n=3, fraction=0.5, quantiles="approx"
    )
    return rows.select("entity", "feature", neat(F.col("num")).alias("num"), "str")
