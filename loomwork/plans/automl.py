"""Predictor and pipeline-search queries (groups L and G) on embeddings and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomwork.functions.stats import neat
from loomwork.operators import automl, column_loop as cl, predictor as pr, sequences as sq
from loomwork.operators.tagging import MODEL, TRANSFORM
from loomwork.plans.common import Registry, table
from loomwork.plans.traces import ROWS_SQL, arg_features, turns
from loomwork.schemas import CANDIDATES

registry = Registry()

SCALER = "pyspark.ml.feature.StandardScaler"
LOGISTIC = "pyspark.ml.classification.LogisticRegression"
TREE = "pyspark.ml.classification.DecisionTreeClassifier"


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("label").cast("double").alias("label"),
        "embedding",
    )
    return cl.as_vector(rows, "embedding", 64)


def customers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("row_id"),
        (F.col("c_acctbal") > 4500).cast("double").alias("label"),
        F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"),
    )


# drawn rows, fitted models and searches have no SQL counterpart: their queries return what must
# hold of the result, row by row where it has rows
@registry.add(
    "cap_rows",
    f"""select least(count(*), {automl.MAX_ROWS}) as drawn, least(count(*), {automl.MAX_ROWS}) as known
from lineitem""",
)
def cap_rows(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows are drawn, and how many of them are rows of the table."""
    lines = table(spark, sf, "lineitem")
    drawn = automl.cap_rows(lines, automl.MAX_ROWS)
    found = lines.select(*lines.columns, F.lit(1).alias("found")).distinct()
    return drawn.join(found, lines.columns, "left").agg(
        F.count(F.lit(1)).alias("drawn"), F.count("found").alias("known")
    )


@registry.add(
    "train_val_split",
    """select c_custkey as row_id, case when
  ('0x' || substr(md5('42|' || c_custkey), 1, 8))::bigint % 10000 < 2000 then 'val' else 'train'
  end as part from customer""",
)
def train_val_split(spark: SparkSession, sf: str) -> DataFrame:
    train, val = automl.train_val_split(customers(spark, sf))
    return train.select("row_id", F.lit("train").alias("part")).unionByName(
        val.select("row_id", F.lit("val").alias("part"))
    )


@registry.add(
    "transform_step",
    """
with s as (select avg(c_acctbal) as ma, stddev_samp(c_acctbal) as sa,
  avg(c_nationkey) as mn, stddev_samp(c_nationkey) as sn from customer)
select c_custkey as row_id, round((c_acctbal - ma) / sa, 6) + 0.0 as balance,
  round((c_nationkey - mn) / sn, 6) + 0.0 as nation from customer, s""",
)
def transform_step(spark: SparkSession, sf: str) -> DataFrame:
    _, done = automl.transform_step(customers(spark, sf), SCALER)
    cells = cl.vector_to_array("features")
    return done.select(
        "row_id", neat(cells[0]).alias("balance"), neat(cells[1]).alias("nation")
    )


@registry.add(
    "column_loop_scale",
    """
with s as (select min(c_acctbal) as a, max(c_acctbal) as b, min(c_nationkey) as c,
  max(c_nationkey) as d from customer)
select c_custkey as row_id, c_mktsegment as segment, round((c_acctbal - a) / (b - a), 6) as balance,
  round((c_nationkey - c) / (d - c)::double, 6) as nation from customer, s""",
)
def column_loop_scale(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("row_id"), F.col("c_acctbal").alias("balance"),
        F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"),
    )
    _, done = automl.transform_step(rows, "pyspark.ml.feature.MinMaxScaler", wrap=True)
    return done.select(
        "row_id", "segment", neat(F.col("balance")).alias("balance"),
        neat(F.col("nation")).alias("nation"),
    )


@registry.add(
    "column_loop_index",
    """
with r as (select c_mktsegment as s, row_number() over (order by count(*) desc, c_mktsegment) - 1
    as i from customer group by c_mktsegment)
select c_custkey as row_id, c_acctbal as balance, i::double as segment
from customer join r on s = c_mktsegment""",
)
def column_loop_index(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("row_id"), F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )
    _, done = automl.transform_step(rows, "pyspark.ml.feature.StringIndexer", wrap=True)
    return done.select("row_id", "balance", "segment")


@registry.add(
    "column_loop_expand",
    """select c_custkey as row_id, round(c_acctbal, 4) as b1, round(c_acctbal * c_acctbal, 4) as b2,
  c_nationkey::double as n1, (c_nationkey * c_nationkey)::double as n2 from customer""",
)
def column_loop_expand(spark: SparkSession, sf: str) -> DataFrame:
    _, done = automl.transform_step(
        customers(spark, sf), "pyspark.ml.feature.PolynomialExpansion", wrap=True
    )
    flat = cl.split_vectors(done)
    names = cl.feature_columns(flat)
    return flat.select(
        "row_id", *[neat(F.col(c), 4).alias(a) for c, a in zip(names, ("b1", "b2", "n1", "n2"))]
    )


@registry.add(
    "column_select",
    """select distinct i as idx from (select generate_subscripts(embedding, 1) - 1 as i,
  unnest(embedding) as v from embeddings) where abs(v) > 0.35""",
)
def column_select(spark: SparkSession, sf: str) -> DataFrame:
    cut = F.transform(
        F.col("embedding").cast("array<double>"),
        lambda x: F.when(F.abs(x) > F.lit(0.35).cast("float"), x).otherwise(0.0),
    )
    rows = table(spark, sf, "embeddings").select(cut.alias("embedding"))
    return cl.used_slots(cl.as_vector(rows, "embedding", 64))


_HELD_SQL = "('0x' || substr(md5('42|' || vec_id), 1, 8))::bigint % 10000 < 2000"


def _known_class(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Add `known`: the prediction is one of the classes."""
    names = classes.select(F.col("label").alias("pred"), F.lit(True).alias("known")).distinct()
    return rows.join(names, "pred", "left").withColumn("known", F.coalesce("known", F.lit(False)))


@registry.add(
    "model_step",
    f"select vec_id as row_id, label::double as label, true as known from embeddings where {_HELD_SQL}",
)
def model_step(spark: SparkSession, sf: str) -> DataFrame:
    train, val = automl.train_val_split(vectors(spark, sf))
    predicted = automl.model_step(train, LOGISTIC).transform(val)
    return _known_class(predicted, train).select("row_id", "label", "known")


@registry.add(
    "score_step", f"select count(*) as rows, true as in_range from embeddings where {_HELD_SQL}"
)
def score_step(spark: SparkSession, sf: str) -> DataFrame:
    train, val = automl.train_val_split(vectors(spark, sf))
    candidate = automl.from_configuration(
        train, [{"role": TRANSFORM, "component": SCALER}, {"role": MODEL, "component": TREE}]
    )
    score = candidate.evaluate(val, "classification", "macro_f1")
    return val.agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "in_range", F.lit(score).between(0.0, 1.0)
    )


def _search(spark: SparkSession, sf: str) -> automl.Search:
    train, val = automl.train_val_split(vectors(spark, sf))
    scorer = pr.RandomScorer(
        [SCALER, "pyspark.ml.feature.PCA"], [LOGISTIC, TREE], seed=7
    )
    return automl.Search(scorer, train.persist(), val.persist(), depth=1, beam=2)


@registry.add(
    "beam_search",
    "select true as found, true as scored, true as ranked, true as ends_in_model, true as within_beam",
)
def beam_search(spark: SparkSession, sf: str) -> DataFrame:
    """Of the candidates: scores in range and descending, a model last, at most two beams of them."""
    search = _search(spark, sf)
    found = search.run()
    rows = [
        (i, [tuple((s.role, s.component, s.wrap, s.log_prob)) for s in c.steps], c.log_prob,
         c.depth, c.score)
        for i, c in enumerate(found)
    ]
    listed = spark.createDataFrame(rows, CANDIDATES)
    before = F.transform(
        F.sort_array(F.collect_list(F.struct("cand_id", "score"))), lambda c: c["score"]
    )
    last = F.element_at("steps", -1)["component"]
    return listed.agg(
        (F.count(F.lit(1)) > 0).alias("found"),
        F.every(F.col("score").between(0.0, 1.0)).alias("scored"),
        (before == F.sort_array(F.collect_list("score"), asc=False)).alias("ranked"),
        F.every(last.startswith("pyspark.ml.classification.")).alias("ends_in_model"),
        (F.count(F.lit(1)) <= 2 * search.beam * (search.depth + 1)).alias("within_beam"),
    )


@registry.add(
    "search_log",
    """select * from (values ('T', 'pyspark.ml.feature.StandardScaler', false),
  ('T', 'pyspark.ml.feature.StandardScaler', true), ('T', 'pyspark.ml.feature.PCA', false),
  ('T', 'pyspark.ml.feature.PCA', true)) as t(role, component, wrap)""",
)
def search_log(spark: SparkSession, sf: str) -> DataFrame:
    """The steps tried; whether a trial ends in time depends on the machine."""
    search = _search(spark, sf)
    search.transforms()
    return search.search_log().select("role", "component", "wrap")


@registry.add("fit_and_vote", "select vec_id as row_id, true as known from embeddings")
def fit_and_vote(spark: SparkSession, sf: str) -> DataFrame:
    scorer = pr.RandomScorer([SCALER], [LOGISTIC, TREE], seed=3)
    fitted = automl.AutoPipeline(scorer).fit(vectors(spark, sf), depth=1, beam=2)
    predicted = fitted.predict(vectors(spark, sf), index=None)
    return _known_class(predicted, vectors(spark, sf)).select("row_id", "known")


@registry.add(
    "fit_and_mean_proba",
    """select c_custkey as row_id, (select count(distinct c_acctbal > 4500) from customer) as classes,
  1.0 as total, true as in_range from customer""",
)
def fit_and_mean_proba(spark: SparkSession, sf: str) -> DataFrame:
    scorer = pr.RandomScorer([SCALER], [LOGISTIC, TREE], seed=3)
    fitted = automl.AutoPipeline(scorer).fit(customers(spark, sf), depth=1, beam=2)
    return fitted.predict_proba(customers(spark, sf)).groupBy("row_id").agg(
        F.count(F.lit(1)).alias("classes"), neat(F.sum("p")).alias("total"),
        F.every(F.col("p").between(0.0, 1.0 + 1e-9)).alias("in_range"),
    )


# ---------------------------------------------------------------- predictor

KEYS = ["prog", "pos"]


def _observations(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a user as a sequence; roles alternate so that both models see classes."""
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("prog"), F.col("event_id").alias("pos"),
        F.col("event_type").alias("component"),
        F.when(F.col("event_type").isin("view", "click"), "T")
        .when(F.col("event_type") == "error", "O").otherwise("M").alias("tag"),
    )
    return sq.observations(rows, 3)


@registry.add(
    "featurize",
    f"""with {ROWS_SQL}, classes as (select component, row_number() over (order by component) - 1 as label
    from (select distinct component from obs))
select prog, pos, (select count(*) from vocab) as width, label::double as label
from obs join classes using (component)""",
)
def featurize(spark: SparkSession, sf: str) -> DataFrame:
    data, _ = pr.featurize(
        sq.observations(turns(spark, sf), 3, dense=True), KEYS, arg_features(spark, sf)
    )
    return data.select(
        "prog", "pos", F.size(cl.vector_to_array("features")).alias("width"), "label"
    )


@registry.add(
    "fit_role_model",
    """select user_id as prog, event_id as pos, (select count(distinct event_type) from events
    where event_type in ('view', 'click')) as classes, 1.0 as total
from events where event_type in ('view', 'click')""",
)
def fit_role_model(spark: SparkSession, sf: str) -> DataFrame:
    obs = _observations(spark, sf)
    model = pr.fit_role_model(obs, TRANSFORM, KEYS)
    return model.rank(obs.filter(F.col("role") == TRANSFORM), None, KEYS).groupBy(*KEYS).agg(
        F.count_distinct("component").alias("classes"), neat(F.sum(F.exp("log_prob"))).alias("total")
    )


@registry.add(
    "predict_component",
    """select role, count(*) as classes, string_agg(c, ' ' order by c) as components, 1.0 as total
from (select distinct event_type as c, case when event_type in ('view', 'click') then 'T' else 'M' end
    as role from events where event_type <> 'error') group by role""",
)
def predict_component(spark: SparkSession, sf: str) -> DataFrame:
    scorer = pr.fit_predictor(_observations(spark, sf), 3, KEYS)
    ranked = [
        (role, c, p)
        for role, pairs in (
            (TRANSFORM, scorer.predict_transforms(spark, ["view"])),
            (MODEL, scorer.predict_models(spark, ["view", "click"])),
        )
        for c, p in pairs
    ]
    listed = spark.createDataFrame(ranked, "role string, component string, log_prob double")
    return listed.groupBy("role").agg(
        F.count(F.lit(1)).alias("classes"),
        F.array_join(F.sort_array(F.collect_list("component")), " ").alias("components"),
        neat(F.sum(F.exp("log_prob"))).alias("total"),
    )


@registry.add(
    "random_ranking",
    "select distinct event_type as component, true as drawn from events where event_type <> 'error'",
)
def random_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Every component once, with the logarithm of a probability."""
    ranked = pr.random_ranking(sq.component_catalog(_observations(spark, sf)), seed=11)
    return ranked.select("component", ((F.col("log_prob") <= 0) & (F.col("log_prob") > -100)).alias("drawn"))
