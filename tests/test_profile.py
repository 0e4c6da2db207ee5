import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.functions import stats
from loomwork.operators import profile as p

from .conftest import rows


def features(df):
    return {r["feature"]: r["num"] if r["num"] is not None else r["str"] for r in df.collect()}


def test_column_of_four_numbers(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (9.0,), (4.0,)], "x double")
    got = {r["stat"]: r["value"] for r in p.numeric_column_stats(df).collect()}
    assert got["skew"] == pytest.approx(0.768417, abs=1e-6)
    assert got["kurtosis"] == pytest.approx(-1.0, abs=1e-9)
    assert got["median"] == 3.0
    assert got["iqr"] == pytest.approx(5.25 - 1.75)
    assert got["geometric_mean"] == pytest.approx(72 ** 0.25)
    assert got["mean"] == 4.0 and got["zscore"] == 0.0


def test_edge_columns(spark):
    df = spark.createDataFrame(
        [(5.0, 0.0, 1.0, -1.0), (5.0, 0.0, None, 0.0), (5.0, 0.0, float("nan"), 2.0)],
        "c double, z double, m double, n double",
    )
    got = {(r["column"], r["stat"]): r["value"] for r in p.numeric_column_stats(df).collect()}
    # a constant column has no z-score, skew 0 and kurtosis -3
    assert ("c", "zscore") not in got
    assert got["c", "skew"] == 0.0 and got["c", "kurtosis"] == -3.0
    # an all-zero column has geometric mean 0 and leaves the nonzero average
    assert got["z", "geometric_mean"] == 0.0 and ("z", "count_nonzero") not in got
    assert got["m", "missing"] == pytest.approx(2 / 3) and got["m", "mean"] == 1.0
    assert math.isnan(got["n", "geometric_mean"])


def test_count_nonzero_ignores_empty_columns(spark):
    df = spark.createDataFrame([(0, 1), (0, 0), (0, 2)], "a int, b int")
    got = features(p.numeric_features(df))
    assert got["colwise_avg_count_nonzero"] == 2.0


def test_propagate_policy(spark):
    df = spark.createDataFrame([(1.0, 1.0), (None, 3.0)], "a double, b double")
    got = {
        (r["column"], r["stat"]): r["value"]
        for r in p.numeric_column_stats(df, nulls="propagate").collect()
    }
    assert math.isnan(got["a", "mean"]) and math.isnan(got["a", "median"])
    assert got["b", "mean"] == 2.0 and got["a", "missing"] == 0.5


@pytest.mark.parametrize("hot", [False, True])
def test_exact_quantiles_match_numpy(spark, hot):
    n = 70_000
    value = F.when(F.lit(hot) & (F.col("id") % 3 == 0), F.lit(7.0)).otherwise(
        F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 17.0
    )
    df = spark.range(n).select(value.alias("v"), (F.col("id") % 2).alias("g"))
    probs = [0.25, 0.5, 0.9]
    local = df.toPandas()
    got = {r["prob"]: r["value"] for r in p.exact_quantiles(df, ["v"], probs).collect()}
    for q in probs:
        assert got[q] == pytest.approx(np.quantile(local["v"], q), rel=1e-12)
    grouped = p.exact_quantiles(df, ["v"], probs, by=["g"]).collect()
    for r in grouped:
        want = np.quantile(local[local["g"] == r["g"]]["v"], r["prob"])
        assert r["value"] == pytest.approx(want, rel=1e-12)


def test_brackets_are_narrowed_until_they_fit(spark):
    # most values lie close together, so that equal ranges hold very different numbers of them
    value = F.exp(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 60_000.0)
    df = spark.range(30_000).select(value.alias("v"), (F.col("id") % 2).alias("g"))
    local = df.toPandas()
    for r in p.exact_quantiles(df, ["v"], [0.1, 0.5], by=["g"], rank_rows=3).collect():
        want = np.quantile(local[local["g"] == r["g"]]["v"], r["prob"])
        assert r["value"] == pytest.approx(want, rel=1e-12)
    constant = spark.range(9).select(F.lit(2.5).alias("v"))
    assert rows(p.exact_quantiles(constant, ["v"], [0.5], rank_rows=0)) == [("v", 0.5, 2.5)]


def test_quantiles_of_one_row(spark):
    df = spark.createDataFrame([(3.5,)], "x double")
    assert rows(p.exact_quantiles(df, ["x"], [0.5])) == [("x", 0.5, 3.5)]


def test_moments_do_not_cancel_far_from_zero(spark):
    df = spark.range(1000).select((F.col("id") % 10 + F.lit(1e9)).alias("x"))
    got = {r["stat"]: r["value"] for r in p.numeric_column_stats(df).collect()}
    assert got["std"] == pytest.approx(np.std(np.arange(10)), rel=1e-9)
    assert got["kurtosis"] == pytest.approx(-1.2242424, abs=1e-6)


def test_nominal(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "s string")
    got = features(p.nominal_features(df, ["s"]))
    assert got["colwise_avg_size_domain_nominal"] == 2
    assert got["colwise_avg_mean_freq_nominal"] == 1.5
    assert got["colwise_avg_min_freq_nominal"] == 1
    assert got["colwise_avg_max_freq_nominal"] == 2
    assert got["colwise_avg_colwise_missing_nominal"] == 0


def test_nominal_cap(spark):
    df = spark.range(500).select("id", F.col("id").cast("string").alias("s"))
    got = features(p.nominal_features(df, ["s"], cap=100, cap_key=["id"]))
    assert got["num_rows_sampled"] == 100 and got["colwise_avg_size_domain_nominal"] == 100


def test_kinds_ignore_times_and_nested(spark):
    df = spark.sql(
        "select 1 as i, 'x' as s, true as b, timestamp'2024-01-01' as t, array(1) as a"
    )
    assert p.column_kinds(df) == {"numeric": ["i"], "nominal": ["s"], "boolean": ["b"]}


def test_boolean(spark):
    df = spark.createDataFrame([(True, False), (True, True)], "a boolean, b boolean")
    got = features(p.boolean_features(df, ["a", "b"]))
    assert got == {
        "colwise_max_fraction_true": 1.0, "colwise_min_fraction_true": 0.5,
        "colwise_avg_fraction_true": 0.75,
    }


@pytest.mark.parametrize("tile_rows", [7, 1000])
def test_row_correlation(spark, tile_rows):
    local = np.random.default_rng(0).normal(size=(40, 5))
    df = spark.createDataFrame(local.tolist(), ", ".join(f"c{i} double" for i in range(5)))
    got = features(p.correlation_features(df, df.columns, extremes=True, tile_rows=tile_rows))
    upper = np.corrcoef(local)[np.triu_indices(40, 1)]
    assert got["matrixwise_max_corr"] == pytest.approx(upper.max())
    assert got["matrixwise_min_corr"] == pytest.approx(upper.min())
    assert got["matrixwise_avg_corr"] == pytest.approx(upper.mean())
    assert list(features(p.correlation_features(df, df.columns))) == ["matrixwise_avg_corr"]


def test_row_correlation_has_no_size_limit(spark):
    x = F.col("id").cast("double")
    big = spark.range(1500).select(
        (F.col("id") % 2).alias("g"), F.sin(x).alias("a"), F.cos(x * 3).alias("b"), (x % 7).alias("c")
    )
    local = big.toPandas()
    for key, part in local.groupby("g"):
        upper = np.corrcoef(part[["a", "b", "c"]].to_numpy())[np.triu_indices(len(part), 1)]
        got = {
            r["feature"]: r["num"]
            for r in p.correlation_features(big, ["a", "b", "c"], ["g"], extremes=True)
            .filter(F.col("entity") == str(key)).collect()
        }
        assert got["matrixwise_avg_corr"] == pytest.approx(upper.mean())
        assert got["matrixwise_max_corr"] == pytest.approx(upper.max())
        assert got["matrixwise_min_corr"] == pytest.approx(upper.min())


def test_equal_rows_correlate_fully(spark):
    df = spark.createDataFrame([(1.0, 2.0, 4.0)] * 5, "a double, b double, c double")
    got = features(p.correlation_features(df, df.columns, extremes=True, tile_rows=2))
    assert {k: round(v, 9) for k, v in got.items()} == {
        "matrixwise_avg_corr": 1, "matrixwise_max_corr": 1, "matrixwise_min_corr": 1,
    }


def test_cells_are_sampled_at_any_size(spark):
    df = spark.range(400).select("id", (F.col("id") / 100).alias("a"), (F.col("id") / 50).alias("b"))
    got = features(p.distribution_features(df, ["a", "b"], cell_share=0.25, cell_key=["id"]))
    count = got["matrixwise_numeric_distribution_num_rows_sampled"]
    assert 140 < count < 260
    again = features(
        p.distribution_features(df.repartition(5), ["a", "b"], cell_share=0.25, cell_key=["id"])
    )
    assert again == pytest.approx(got)


def test_erf(spark):
    values = [-math.inf, -8.0, -1.5, -1e-3, 0.0, 0.46875, 4.0, 6.5, math.inf]
    values += [i / 97 for i in range(-700, 700)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(stats.erf(F.col("x"))).collect()]
    assert got == pytest.approx([math.erf(v) for v in values], abs=1e-15)
    odd = spark.createDataFrame([(math.nan,), (None,)], "x double").select(stats.erf(F.col("x")))
    plan = odd._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and math.isnan(odd.collect()[0][0]) and odd.collect()[1][0] is None


def test_cumulative_curves(spark):
    df = spark.createDataFrame([(0.0,), (2.0,)], "x double")
    got = features(p.distribution_features(df, ["x"], curves=("cdf",)))
    norm = (0.5 + (1 + math.erf(math.sqrt(2))) / 2) / 2
    assert got["matrixwise_avg_dist_norm_cdf"] == pytest.approx(norm)
    assert got["matrixwise_avg_dist_chi2_cdf"] == pytest.approx(math.erf(1.0) / 2)
    assert got["matrixwise_avg_dist_expon_cdf"] == pytest.approx((1 - math.exp(-2)) / 2)


def test_infinite_density_is_dropped_by_profile(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 5.0), (3.0, 4.0)], "x double, y double")
    assert "matrixwise_avg_dist_chi2_pdf" not in features(p.profile(df))
    kept = features(p.profile(df, keep_bad=True))
    assert kept["matrixwise_avg_dist_chi2_pdf"] == math.inf


def test_profile_of_mixed_table_and_grouped_input(spark):
    df = spark.createDataFrame([(1, "a", True), (2, "b", False)], "n int, s string, b boolean")
    got = features(p.profile(df))
    assert got["num_rows"] == 2 and got["arg_type"] == "DataFrame"
    assert got["count_column_type_f"] == 1 and got["count_column_type_O"] == 1
    assert features(p.profile(df.groupBy("s")))["num_rows"] == 2
    assert features(p.profile((df, "n")))["colwise_avg_mean"] == 1.5
    with pytest.raises(TypeError):
        p.profile([1, 2])
    assert features(p.unhandled_features(spark, "dict"))["unhandled"] == 1.0


def test_bootstrap_keeps_true_row_count(spark):
    df = spark.range(200).select("id", (F.col("id") * 1.0).alias("x"))
    got = features(p.bootstrap_profile(df, ["id"], 3, 0.5, quantiles="approx"))
    assert got["num_rows"] == 200 and got["sample_params"] == "3,0.5"
    assert 60 < got["colwise_avg_mean"] < 140


def test_cache_profiles_once(spark):
    cache = p.ProfileCache(quantiles="approx")
    df = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    first = cache.get("a", df)
    assert cache.get("a") is first and cache.get("b") is None
    assert {r["entity"] for r in first.collect()} == {"a"}
    cache.clear()


def test_sparse_matches_dense(spark):
    dense = np.array([[0, 2.0, 0], [1.0, 0, 0], [0, 3.0, 0], [4.0, 0, 0]])
    entries = spark.createDataFrame(
        [(int(i), int(j), float(dense[i, j])) for i, j in zip(*np.nonzero(dense))],
        "row int, idx int, value double",
    )
    got = {r["idx"]: r for r in p.sparse_column_stats(entries, 4, 3).collect()}
    assert got[0]["mean"] == pytest.approx(dense[:, 0].mean())
    assert got[1]["std"] == pytest.approx(dense[:, 1].std())
    total = features(p.sparse_features(entries, 4, 3))
    assert total["colwise_avg_count_nonzero"] == 2.0
    assert total["colwise_avg_mean"] == pytest.approx(dense.mean(axis=0).mean())
    assert "colwise_avg_skew" not in total  # the empty column has none


def test_rows_of_few_groups_are_not_gathered(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        df = spark.range(1000).selectExpr("id % 2 as g", "cast(id as double) as x")
        plan = p._bracketed(p._numbers(df, ["g"], ["x"]), ["x"], [0.5], ["g"])
        assert "SortMergeJoin" not in plan._jdf.queryExecution().executedPlan().toString()
        got = {r.g: r.value for r in p.exact_quantiles(df, ["x"], [0.5], ["g"]).collect()}
        assert got == {0: 499.0, 1: 500.0}
    finally:
        spark.conf.set(key, before)
