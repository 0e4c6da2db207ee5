"""Next-component predictor over n-gram observations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import (
    CountVectorizerModel, StringIndexer, VectorAssembler, VectorSizeHint,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from loomwork.operators import catalog, profile as pf, sequences as sq
from loomwork.operators.tagging import MODEL, TRANSFORM
from loomwork.session import cut_lineage



def default_classifier(rows: int) -> LogisticRegression:
    """L1-penalized logistic regression with a penalty that does not grow with the rows."""
    return LogisticRegression(
        elasticNetParam=1.0, regParam=1.0 / max(rows, 1), standardization=False, maxIter=50
    )


def tokens_and_numbers(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., tokens, numbers) from long feature rows; a row has few features."""
    named = sq.encoded_names(rows)
    is_text = F.col("str").isNotNull()
    return named.groupBy(*keys).agg(
        F.collect_list(F.when(is_text, F.col("name"))).alias("tokens"),
        F.map_from_entries(
            F.collect_list(F.when(~is_text, F.struct("feature", "num")))
        ).alias("numbers"),
    )


@dataclass
class Vectorizer:
    """Sorted vocabulary of one-hot names and of numeric features."""

    names: list[str]
    numbers: list[str]

    @classmethod
    def fit(cls, rows: DataFrame) -> Vectorizer:
        named = sq.encoded_names(rows).select(
            "name", F.col("str").isNotNull().alias("text")
        ).distinct()
        found = named.collect()  # the names of a model's features, not rows
        return cls(
            sorted(r["name"] for r in found if r["text"]),
            sorted(r["name"] for r in found if not r["text"]),
        )

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        """Absent features are 0, names outside the vocabulary are dropped."""
        parts = []
        if self.names:
            onehot = CountVectorizerModel.from_vocabulary(self.names, "tokens", "__onehot")
            df = onehot.setBinary(True).setMinTF(1.0).transform(df)
            parts.append("__onehot")
        if self.numbers:
            wanted = F.array(*[F.lit(n) for n in self.numbers])
            values = F.transform(
                wanted, lambda n: F.coalesce(F.element_at("numbers", n), F.lit(0.0))
            )
            df = df.withColumn("__numbers", array_to_vector(values))
            parts.append("__numbers")
        joined = VectorAssembler(inputCols=parts, outputCol=out, handleInvalid="keep")
        if "__numbers" in parts:
            hint = VectorSizeHint(
                inputCol="__numbers", size=len(self.numbers), handleInvalid="optimistic"
            )
            df = hint.transform(df)
        return joined.transform(df).drop(*parts)


@dataclass
class RoleModel:
    """Classifier of one role, or only its classes when no classifier was asked for."""

    role: str
    classes: list[str]
    vectorizer: Vectorizer | None
    model: object | None

    def rank(self, obs: DataFrame, arg_features: DataFrame | None, keys: list[str]) -> DataFrame:
        """(keys..., component, log_prob) best first; ties in class order."""
        rows = sq.feature_rows(obs, keys, arg_features)
        data = self.vectorizer.transform(tokens_and_numbers(rows, keys))
        scored = self.model.transform(data).select(
            *keys, F.posexplode(vector_to_array("probability")).alias("idx", "p")
        ).filter(F.col("idx") < len(self.classes))  # a lone class still has two slots
        names = F.array(*[F.lit(c) for c in self.classes])
        log_prob = F.when(F.col("p") > 0, F.ln("p")).otherwise(F.lit(float("-inf")))
        return scored.select(
            *keys, F.element_at(names, F.col("idx") + 1).alias("component"),
            log_prob.alias("log_prob"), "idx",
        ).orderBy(*keys, F.desc("log_prob"), "idx").drop("idx")


def featurize(
    obs: DataFrame, keys: list[str], arg_features: DataFrame | None = None
) -> tuple[DataFrame, Vectorizer]:
    """(keys..., features, component, label): one vector and one label per observation."""
    rows = sq.feature_rows(obs, keys, arg_features)
    vectorizer = Vectorizer.fit(rows)
    data = vectorizer.transform(tokens_and_numbers(rows, keys)).join(
        obs.select(*keys, "component"), keys
    )
    indexer = StringIndexer(
        inputCol="component", outputCol="label", stringOrderType="alphabetAsc"
    )
    return indexer.fit(data).transform(data), vectorizer


def fit_role_model(
    obs: DataFrame,
    role: str,
    keys: list[str],
    classifier=default_classifier,
    arg_features: DataFrame | None = None,
) -> RoleModel:
    """Model of the observations of one role; classifier=None keeps only the classes."""
    rows = cut_lineage(obs.filter(F.col("role") == role))
    if classifier is None:
        found = rows.select("component").distinct().collect()
        return RoleModel(role, sorted(r[0] for r in found), None, None)
    data, vectorizer = featurize(rows, keys, arg_features)
    data = data.select("features", "label", "component").persist()
    try:
        found = data.select("component").distinct().collect()
        estimator = classifier(data.count())
        model = Pipeline(stages=[estimator]).fit(data)
    finally:
        data.unpersist()
    return RoleModel(role, sorted(r[0] for r in found), vectorizer, model)


@dataclass
class NGramScorer:
    """Ranks next components from the previous n - 1 steps and the shape of the data."""

    n: int
    transforms: RoleModel
    models: RoleModel
    with_data: bool = False

    def _rank(self, spark, steps: list[str], role_model: RoleModel, data: DataFrame | None):
        prev = ([sq.START] * (self.n - 1) + steps)[-(self.n - 1):] if self.n > 1 else []
        obs = spark.createDataFrame(
            [(0, role_model.role, prev)], "k int, role string, prev array<string>"
        )
        features = None
        if self.with_data and data is not None:
            features = pf.profile(data, quantiles="approx").select(
                F.lit(0).alias("k"), F.lit(0).alias("arg"), "feature", "num", "str"
            )
        ranked = role_model.rank(obs, features, ["k"])
        return [(r["component"], r["log_prob"]) for r in ranked.collect()]

    def predict_transforms(self, spark, steps, data=None):
        return self._rank(spark, steps, self.transforms, data)

    def predict_models(self, spark, steps, data=None):
        return self._rank(spark, steps, self.models, data)


def fit_predictor(
    obs: DataFrame,
    n: int,
    keys: list[str],
    classifier=default_classifier,
    arg_features: DataFrame | None = None,
) -> NGramScorer:
    """A transform model and a model model over one observation set."""
    return NGramScorer(
        n,
        fit_role_model(obs, TRANSFORM, keys, classifier, arg_features),
        fit_role_model(obs, MODEL, keys, classifier, arg_features),
        arg_features is not None,
    )


def random_ranking(components: DataFrame, seed: int) -> DataFrame:
    """(component, log_prob): components in random order with uniform random probabilities.

    1 - rand lies in (0, 1], so the logarithm is always finite.
    """
    return (
        components.select("component", F.ln(1 - F.rand(seed)).alias("log_prob"))
        .orderBy(F.rand(seed + 1))
    )


class RandomScorer:
    """Null-hypothesis baseline: any seen component, in random order."""

    def __init__(self, transforms: list[str], models: list[str], seed: int = 0):
        self._pools = {TRANSFORM: sorted(transforms), MODEL: sorted(models)}
        self._seed = seed

    def _rank(self, spark, role):
        self._seed += 2
        pool = spark.createDataFrame([(c,) for c in self._pools[role]], "component string")
        ranked = random_ranking(pool.coalesce(1), self._seed)
        return [(r["component"], r["log_prob"]) for r in ranked.collect()]

    def predict_transforms(self, spark, steps, data=None):
        return self._rank(spark, TRANSFORM)

    def predict_models(self, spark, steps, data=None):
        return self._rank(spark, MODEL)


def random_predictor(obs: DataFrame, keys: list[str], seed: int = 0) -> RandomScorer:
    """Random scorer over the components seen in the observations."""
    return RandomScorer(
        fit_role_model(obs, TRANSFORM, keys, None).classes,
        fit_role_model(obs, MODEL, keys, None).classes, seed,
    )


def library_scorer(task: str = "classification", seed: int = 0) -> RandomScorer:
    """Random scorer over everything the library offers."""
    return RandomScorer(
        catalog.library_catalog(TRANSFORM), catalog.library_catalog(MODEL, task), seed
    )
