import pytest
from pyspark.sql import functions as F

from loomwork.operators import (
    automl, candidates as cd, catalog, column_loop as cl, ensemble, evaluate, predictor as pr,
    sequences as sq,
)

from .conftest import rows

SCALER = "pyspark.ml.feature.MinMaxScaler"
TREE = "pyspark.ml.classification.DecisionTreeClassifier"
LOGISTIC = "pyspark.ml.classification.LogisticRegression"


@pytest.fixture(scope="module")
def points(spark):
    """Two numeric features that decide the label, and a string feature."""
    x = (F.col("id") * 37 % 101) / 10.0
    y = (F.col("id") * 53 % 97) / 10.0
    return spark.range(400).select(
        F.col("id").alias("row_id"), x.alias("x"), y.alias("y"),
        (x > 5).cast("double").alias("label"),
    ).persist()


def test_macro_f1(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "label int, pred int")
    # f1: 2/3, 1/2, 0
    assert evaluate.macro_f1(df).first()["score"] == pytest.approx((2 / 3 + 0.5) / 3)
    assert evaluate.macro_f1(df.limit(0)).first()["score"] == 0.0


def test_r2(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.5), (4.0, 4.0)], "label double, pred double")
    total = sum((v - 7 / 3) ** 2 for v in (1, 2, 4))
    assert evaluate.r2(df).first()["score"] == pytest.approx(1 - 0.25 / total)


def test_votes(spark):
    votes = spark.createDataFrame(
        [(0, 1), (0, 2), (0, 2), (1, 1), (1, 2)], "row_id long, pred int")
    assert rows(ensemble.majority_vote(votes)) == [(0, 2), (1, 1)]


def test_mean_proba_leaves_out_other_widths(spark):
    df = spark.createDataFrame(
        [(0, 0, [0.2, 0.8]), (1, 0, [0.4, 0.4]), (2, 0, [1.0, 0.0, 0.0]), (3, 0, None)],
        "program int, row_id long, proba array<double>")
    got = rows(ensemble.mean_proba(df))
    assert got == [(0, 0, pytest.approx(1 / 3)), (0, 1, pytest.approx(2 / 3))]
    assert ensemble.mean_proba(df.filter("proba is null")).count() == 0


def test_enumeration_size(spark):
    got = cd.enumerate_configs(spark, ["t1", "t2"], ["m1", "m2", "m3"], 2)
    assert got.count() == 3 * (4 + 16) and got.distinct().count() == 60


def test_any_slice_of_an_enumeration_is_made_alone(spark):
    names = spark.createDataFrame([("t1",), ("t2",), ("t2",), (None,)], "n string")
    whole = {r.config_id: r.steps for r in cd.enumerate_configs(spark, names, ["m1", "m2", "m3"], 2).collect()}
    assert sorted(whole) == list(range(60))
    got = cd.enumerate_configs(spark, names, ["m1", "m2", "m3"], 2, first=7, count=20).collect()
    assert {r.config_id: r.steps for r in got} == {i: whole[i] for i in range(7, 27)}
    far = cd.enumerate_configs(spark, ["t1", "t2"], ["m1"], 8, first=4**7, count=3).collect()
    assert sorted(r.config_id for r in far) == [4**7, 4**7 + 1, 4**7 + 2]
    assert cd.enumerate_configs(spark, [], ["m1"], 2).count() == 0
    with pytest.raises(ValueError):
        cd.enumerate_configs(spark, ["t1", "t2"], ["m1"], 40)


def test_prune(spark):
    df = spark.createDataFrame(
        [(1, 1, -1.0), (2, 1, -0.5), (3, 1, -0.5), (4, 2, -9.0)],
        "cand_id long, len int, log_prob double")
    ids = lambda d: [r["cand_id"] for r in d.orderBy("cand_id").collect()]
    assert ids(cd.prune_topk(df, 1, ["len"])) == [2, 4]
    assert ids(cd.prune_topk(df, 2)) == [2, 3]
    assert ids(cd.prune_topk(df, None)) == ids(cd.prune_topk(df, 0)) == [1, 2, 3, 4]


def test_repeated_component_is_refused(spark):
    start = cd.empty_candidate(spark)
    opts = spark.createDataFrame(
        [(0, "T", "a", False, -1.0)],
        "cand_id long, role string, component string, wrap boolean, log_prob double")
    one = cd.extend(start, opts)
    again = opts.drop("cand_id").crossJoin(one.select("cand_id")).withColumn("wrap", F.lit(True))
    assert one.first()["depth"] == 1 and one.first()["log_prob"] == -1.0
    assert cd.extend(one, again).count() == 0


def test_render_names_every_step(spark):
    steps = F.array(
        cd.step(F.lit("T"), F.lit("a.b.C"), F.lit(True), F.lit(0.0)),
        cd.step(F.lit("M"), F.lit("a.d.E"), F.lit(False), F.lit(0.0)))
    code = spark.range(1).select(cd.render(steps)).first()[0]
    assert "t0 = ColumnLoop(a.b.C)" in code and "stages=[t0, model]" in code


def test_catalog_refuses_unknown_names():
    with pytest.raises(KeyError):
        catalog.resolve("os.system")
    assert all(catalog.resolve(n).role == "M" for n in catalog.library_catalog("M"))
    assert TREE in catalog.library_catalog("M") and TREE not in catalog.library_catalog("M", "regression")


def test_columns_that_fail_are_named(spark, monkeypatch):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 4.0)], "row_id long, a double, b double")
    single, bad = cl.ColumnLoop._single, {"b"}

    def some(part, df, col, i):
        if col in bad:
            raise ValueError(f"no {col}")
        return single(part, df, col, i)

    monkeypatch.setattr(cl.ColumnLoop, "_single", staticmethod(some))
    loop = cl.ColumnLoop("pyspark.ml.feature.PolynomialExpansion")
    model = loop.fit(df)
    assert model.failed == {"b": "ValueError: no b"} and model.transform(df).count() == 2
    bad.add("a")
    with pytest.raises(ValueError, match="a: ValueError: no a; b: ValueError: no b"):
        loop.fit(df)


def test_column_loop_in_place_and_appended(spark):
    df = spark.createDataFrame([(1, 0.0, 2.0, "u"), (2, 4.0, 6.0, "v")],
                               "row_id int, a double, b double, s string")
    _, scaled = automl.transform_step(df, SCALER, wrap=True)
    assert rows(scaled.select("row_id", "a", "b", "s")) == [(1, 0.0, 0.0, "u"), (2, 1.0, 1.0, "v")]
    _, wide = automl.transform_step(df, "pyspark.ml.feature.PolynomialExpansion", wrap=True)
    assert wide.columns[:2] == ["row_id", "s"] and cl.width(wide.drop("s")) == 4
    _, coded = automl.transform_step(df, "pyspark.ml.feature.StringIndexer", wrap=True)
    assert rows(coded.select("s")) == [(0.0,), (1.0,)]


def test_fitted_loop_applies_to_other_rows(spark):
    df = spark.createDataFrame([(0.0,), (10.0,)], "a double")
    model, _ = automl.transform_step(df, SCALER, wrap=True)
    other = spark.createDataFrame([(5.0,)], "a double")
    assert model.transform(other).first()["a"] == 0.5


def test_vector_slots(spark):
    df = cl.as_vector(spark.createDataFrame([([0.0, 1.0],), ([0.0, 0.0],)], "v array<double>"),
                      "v", 2)
    assert rows(cl.used_slots(df)) == [(1,)]
    assert cl.split_vectors(df).columns == ["features_0", "features_1"]


def test_cap_rows(spark):
    df = spark.range(5000)
    assert automl.cap_rows(df, 1000).count() == 1000
    assert automl.cap_rows(df, 5000).count() == 5000


@pytest.mark.parametrize("seed", [1, 2, 42])
def test_cap_rows_just_above_the_cap(spark, seed):
    capped = automl.cap_rows(spark.range(10_001), 10_000, seed)
    assert capped.count() == 10_000
    assert rows(capped) == rows(capped)


def test_a_failing_transform_is_found_by_the_trial(spark, points):
    bad = points.withColumn(
        "x_bad", F.when(F.col("row_id") >= 0, F.raise_error(F.lit("cannot run")).cast("double"))
    )
    candidate = automl.Candidate(bad)
    with pytest.raises(Exception, match="cannot run"):
        automl.check_runs(candidate.data)


def test_split_is_stable(spark, points):
    train, val = automl.train_val_split(points)
    assert train.count() + val.count() == 400
    assert rows(val) == rows(automl.train_val_split(points.repartition(7))[1])


def test_configuration_and_score(spark, points):
    config = [{"role": "T", "component": SCALER}, {"role": "M", "component": TREE}]
    candidate = automl.from_configuration(points, config)
    assert candidate.depth == 1
    assert candidate.evaluate(points, "classification", "macro_f1") > 0.95
    with pytest.raises(ValueError):
        automl.from_configuration(points, [{"role": "X", "component": TREE}])
    with pytest.raises(ValueError):
        candidate.extend(automl.Step("M", TREE))


def test_trial_over_time_is_cancelled(spark, points):
    search = automl.Search(None, points)

    with pytest.raises(TimeoutError):
        search.limited(lambda: spark.range(200).select(
            F.udf(lambda v: __import__("time").sleep(0.2) or v, "long")("id").alias("v")
        ).agg(F.sum("v")).collect(), 1.0)


def test_search_end_to_end(spark, points):
    scorer = pr.RandomScorer([SCALER, "pyspark.ml.feature.Imputer"], [LOGISTIC, TREE], seed=1)
    fitted = automl.AutoPipeline(scorer, max_rows=300).fit(points, depth=1, beam=2)
    assert fitted.candidates and fitted.candidates[0].score > 0.8
    scores = [c.score for c in fitted.candidates]
    assert scores == sorted(scores, reverse=True)
    log = fitted.search.search_log()
    assert cd.search_summary(log).agg(F.sum("tried")).first()[0] == log.count()
    one = fitted.predict(points)
    voted = fitted.predict(points, index=None)
    assert one.count() == voted.count() == 400
    total = fitted.predict_proba(points).groupBy("row_id").agg(F.sum("p").alias("s"))
    assert total.filter(F.abs(F.col("s") - 1) > 1e-9).count() == 0
    assert fitted.predict_proba(points, index=0).count() == 800


def observations(spark):
    pattern = ["load", "scale", "fit", "score"] * 30
    tags = {"load": "O", "scale": "T", "fit": "M", "score": "T"}
    df = spark.createDataFrame(
        [("p", i, c, tags[c]) for i, c in enumerate(pattern)],
        "prog string, pos long, component string, tag string")
    return sq.observations(df, 2)


def test_predictor_learns_the_next_component(spark):
    obs = observations(spark)
    args = obs.select("prog", "pos", F.lit(0).alias("arg"), F.lit("num_rows").alias("feature"),
                      F.lit(5.0).alias("num"), F.lit(None).cast("string").alias("str"))
    scorer = pr.fit_predictor(obs, 2, ["prog", "pos"], arg_features=args)
    assert scorer.predict_transforms(spark, ["load"])[0][0] == "scale"
    assert scorer.predict_transforms(spark, ["fit"])[0][0] == "score"
    assert scorer.predict_models(spark, ["scale"])[0][0] == "fit"


def test_random_predictor_ranks_seen_components(spark):
    scorer = pr.random_predictor(observations(spark), ["prog", "pos"])
    ranked = scorer.predict_transforms(spark, [])
    assert sorted(c for c, _ in ranked) == ["scale", "score"] and all(p <= 0 for _, p in ranked)
    assert pr.library_scorer().predict_models(spark, [])


def test_vectorizer_drops_unknown_names(spark):
    v = pr.Vectorizer(["a=x", "b=y"], ["n"])
    df = spark.createDataFrame(
        [(["b=y", "b=z"], {"n": 2.0}), ([], {})], "tokens array<string>, numbers map<string,double>")
    got = [list(r["features"].toArray()) for r in v.transform(df).collect()]
    assert got == [[0.0, 1.0, 2.0], [0.0, 0.0, 0.0]]
